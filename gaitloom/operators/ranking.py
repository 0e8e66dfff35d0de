"""Lexical and dense retrieval, fusion, reranking, diversification, sampling and paging.

Every operator works on batches: ``query_id`` is a column, a single request is a batch of one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import query_tokens
from ..plans.runtime import bounded
from .postings import Index, unpublished

#: Requests are configuration of a run; more in one batch is an error, so what is broadcast stays small.
MOST_QUERIES = 100_000


class EmptyQuery(ValueError):
    """A request without any search token, in any mode."""


def query_table(spark: SparkSession, queries: Sequence[tuple[str, str]]) -> DataFrame:
    """``(query_id, query, token, qc, terms)`` of a bounded batch of requests."""
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in a batch")
    rows = []
    for key, said in queries:
        counts = Counter(query_tokens(said))
        if not counts:
            raise EmptyQuery(key)
        rows += [(key, " ".join(said.split()), token, n, len(counts)) for token, n in counts.items()]
    return spark.createDataFrame(rows, "query_id string, query string, token string, qc int, terms int")


def _weighted_hits(index: Index, queries: DataFrame, k1: float, b: float, weight) -> DataFrame:
    """``(query_id, query, terms, object_id, raw, matched)``: summed term weights; document frequencies of the query's tokens only."""
    tokens = [r.token for r in queries.select("token").distinct().collect()]  # bounded by MOST_QUERIES requests
    hits = index.hits(tokens)
    df = bounded(hits.groupBy("token").agg(F.count("*").alias("df")), max(1, len(tokens)))
    told = queries.join(df, "token").select("query_id", "query", "token", "qc", "terms", weight(F.lit(float(index.documents)), F.col("df")).alias("idf"))
    part = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / index.mean_length))
    return (
        hits.join(bounded(told, 64 * MOST_QUERIES), "token")
        .groupBy("query_id", "query", "object_id", "terms")
        .agg(F.sum(F.col("idf") * part * F.least(F.col("qc"), F.lit(2))).alias("raw"), F.sum(F.col("idf") * part).alias("plain"), F.count("*").alias("matched"))
    )


def candidates(index: Index | DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``(query_id, object_id, match)``: the ``limit`` best matches of every query's tokens, as a full-text table orders them.

    Plain BM25 with k1 = 1.2 and b = 0.75, each distinct token counting once; ties go to the smaller object id.
    """
    index = index if isinstance(index, Index) else unpublished(index)
    rare = lambda n, df: F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    found = _weighted_hits(index, queries, 1.2, 0.75, rare).select("query_id", "object_id", F.round("plain", 6).alias("match"))
    return top(found, limit, [F.desc("match"), F.asc("object_id")], rank="place").drop("place")


def candidate_limit(k: int) -> int:
    """How many candidates a search for k results scores."""
    return max(8 * k, 1000)


def lexical_scores(index: Index | DataFrame, queries: DataFrame, *, limit: int | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query_id, object_id, dataset, motion_id, score)`` of every entry that holds a query token, or of the ``limit`` best.

    BM25 times coverage plus the substring and identity bonuses. Only postings of query tokens leave the scan; entries are
    joined to scored rows only.
    """
    index = index if isinstance(index, Index) else unpublished(index)
    common = lambda n, df: F.log(1 + (n - df + 0.5) / (df + 0.5))
    scored = _weighted_hits(index, queries, k1, b, common).where("raw > 0")
    if limit is not None:
        scored = scored.join(candidates(index, queries, limit).select("query_id", "object_id"), ["query_id", "object_id"], "left_semi")
    scored = scored.join(index.entry.select("object_id", "dataset", "motion_id", "search_text"), "object_id")
    q = F.lower("query")
    bonus = (
        F.when(F.lower("search_text").contains(q), 3.0).otherwise(0.0)
        + F.when(q == F.lower("motion_id"), 4.0).otherwise(0.0)
        + F.when((q == F.lower("motion_id")) | (q == F.lower("dataset")), 1.0).otherwise(0.0)
    )
    score = F.round(F.col("raw") * (0.65 + F.col("matched") / F.col("terms")) + bonus, 6)
    return scored.select("query_id", "object_id", "dataset", "motion_id", score.alias("score"))


def top(scored: DataFrame, k: int, by: Sequence[Column], *, within: Sequence[str] = ("query_id",), rank: str = "rank") -> DataFrame:
    """The first k rows of every query (WindowGroupLimit keeps k a map task)."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col(rank) <= max(int(k), 1))


def lexical_top(scored: DataFrame, k: int) -> DataFrame:
    return top(scored, k, [F.desc("score"), F.asc("dataset"), F.asc("motion_id"), F.asc("object_id")])


def dense_scores(captions: DataFrame, vectors: dict[str, Sequence[Sequence[float]]], id_cols: Iterable[str] = ("vec_id", "object_id"), *, keep: int | None = None) -> DataFrame:
    """``(query_id, *ids, score)``: dot product with the first vector of a query, or 0.6 of it plus 0.4 of the best clause's.

    Vectors of a query are the whole text's and its clauses' after the first. One matrix product a batch of rows;
    the query matrix is the bounded request batch. Rows without a vector of that length are left out. With ``keep`` only
    that many best rows of a batch leave the worker for each query (by score to nine digits, then the first id), as no
    others can be among the best of all.
    """
    names, start, flat = [], [], []
    for name, own in vectors.items():
        names.append(name)
        start.append(len(flat))
        flat += [list(v) for v in own]
    if len(names) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in a batch")
    matrix, ends = np.asarray(flat, np.float64), [*start[1:], len(flat)]
    ids = list(id_cols)
    kinds = ", ".join(f"{c} {captions.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches):
        for pdf in batches:
            good = pdf[pdf["embedding"].map(lambda v: v is not None and len(v) == matrix.shape[1])]
            if not len(good):
                continue
            dots = np.stack(good["embedding"].to_numpy()).astype(np.float64) @ matrix.T
            out = []
            for name, a, z in zip(names, start, ends):
                s = dots[:, a] if z - a == 1 else 0.6 * dots[:, a] + 0.4 * dots[:, a + 1 : z].max(1)
                rows = good
                if keep is not None and len(s) > keep:
                    at = np.lexsort((good[ids[0]].to_numpy(), -np.round(s, 9)))[:keep]
                    s, rows = s[at], good.iloc[at]
                out.append(pd.DataFrame({"query_id": name, **{c: rows[c] for c in ids}, "score": s}))
            yield pd.concat(out)

    return captions.where("embedding IS NOT NULL").select(*ids, "embedding").mapInPandas(run, f"query_id string, {kinds}, score double")


def best_of_object(ranked: DataFrame) -> DataFrame:
    """First hit of every object in a ranked list."""
    rest = [c for c in ranked.columns if c not in ("query_id", "object_id")]
    return ranked.groupBy("query_id", "object_id").agg(F.min_by(F.struct(*rest), "rank").alias("r")).select("query_id", "object_id", "r.*")


def fuse(lexical: DataFrame, dense: DataFrame, known: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists; objects without an entry drop out."""
    a = lexical.select("query_id", "object_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    b = dense.select("query_id", "object_id", F.col("rank").alias("dense_rank"), F.col("score").alias("semantic_score"))
    fused = F.coalesce(0.45 / (60 + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(0.55 / (60 + F.col("dense_rank")), F.lit(0.0))
    return a.join(b, ["query_id", "object_id"], "full").join(known.select("object_id", "dataset", "motion_id"), "object_id").withColumn("fused", fused)


def overlap_score(query: Column, document: Column) -> Column:
    """Deterministic stand-in for a cross-encoder: share of query tokens the document holds, as a logit-like number."""
    q, d = F.array_distinct(X.tokens(query)), F.array_distinct(X.tokens(document))
    return 4.0 * F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1)) - 2.0


def rerank(candidates: DataFrame, score=overlap_score) -> DataFrame:
    """Scores of a shortlist: the title's, or the caption's up to one above it; exact ids and titles come first.

    Needs ``query, base_score, source_title, description, captions, motion_id``; ``score`` is a scorer of two text
    columns, for example a pandas UDF around a model.
    """
    texts = F.filter(F.array_distinct(F.concat(F.array("description"), F.col("captions"))), lambda t: X.searchable(X.clean_caption(t)))
    document = F.substring(F.array_join(texts, " "), 1, 3000)
    titled = F.length("source_title") > 0
    by_title, by_caption = score(F.col("query"), F.col("source_title")), score(F.col("query"), document)
    base = F.when(titled, F.greatest(by_title, F.least(by_caption, by_title + 1.0))).otherwise(by_caption)
    q = X.match_key("query")
    exact = (q == X.match_key("motion_id")) | (q == X.match_key("source_title"))
    return (
        candidates.withColumn("title_score", F.when(titled, by_title))
        .withColumn("caption_score", by_caption)
        .withColumn("exact_source_match", exact)
        .withColumn("reranker_score", base + F.when(exact, 100.0).otherwise(0.0) + F.least(F.col("base_score"), F.lit(1.0)) * 0.01)
    )


def diversify(shortlist: DataFrame) -> DataFrame:
    """``(query_id, object_id, place)``: greedy order by normalised score less similarity to those chosen before.

    A shortlist is bounded (20); it is folded inside the row by SQL higher-order functions. Ties prefer the larger
    score, then the larger motion id. Needs ``score, motion_id, series_key, source_title, description``.
    """
    words = F.array_distinct(X.tokens(F.when(F.length("source_title") > 0, F.col("source_title")).otherwise(F.col("description"))))
    item = F.struct("object_id", "score", "motion_id", F.coalesce("series_key", F.lit("")).alias("series_key"), words.alias("words"))
    grouped = shortlist.groupBy("query_id").agg(F.collect_list(item).alias("items"), F.min("score").alias("low"), F.max("score").alias("high"))
    similarity = "IF(x.series_key <> '' AND x.series_key = c.series_key, 1D, IF(size(array_union(x.words, c.words)) = 0, 0D, size(array_intersect(x.words, c.words)) / size(array_union(x.words, c.words))))"
    worth = f"(x.score - low) / greatest(high - low, 1e-6D) - least(0.75D, 0.15D * aggregate(acc, 0D, (s, c) -> s + {similarity}))"
    best = f"array_max(transform(filter(items, x -> NOT exists(acc, c -> c.object_id = x.object_id)), x -> named_struct('worth', {worth}, 'score', x.score, 'motion_id', x.motion_id, 'object_id', x.object_id, 'series_key', x.series_key, 'words', x.words)))"
    fold = f"aggregate(sequence(1, size(items)), filter(items, x -> false), (acc, k) -> concat(acc, transform(array({best}), b -> named_struct('object_id', b.object_id, 'score', b.score, 'motion_id', b.motion_id, 'series_key', b.series_key, 'words', b.words))))"
    return grouped.select("query_id", F.posexplode(F.expr(fold)).alias("at", "x")).select("query_id", "x.object_id", (F.col("at") + 1).alias("place"))


def uniform(key: Column) -> Column:
    """Uniform number in (0, 1) that depends on a text only."""
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def sample(ranked: DataFrame, k: int, randomness: float, seed: str) -> DataFrame:
    """Exploratory draw of k without replacement, weights exp(score / (top * randomness)), as Gumbel top-k.

    Off (the ranked order stays) without randomness or where the first score isn't positive.
    """
    if randomness <= 0:
        return ranked.where(F.col("rank") <= max(k, 1)).withColumn("place", F.col("rank"))
    head = Window.partitionBy("query_id")
    first = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(head)
    heat = F.greatest(first * randomness, F.lit(1e-6))
    noise = -F.log(-F.log(uniform(F.concat_ws(":", F.lit(str(seed)), "query_id", "object_id"))))
    key = F.when(first > 0, F.col("score") / heat + noise).otherwise(-F.col("rank"))
    return ranked.withColumn("key", key).withColumn("place", F.row_number().over(head.orderBy(F.desc("key"), "object_id"))).where(F.col("place") <= max(k, 1)).drop("key")


def merge_reranked(rows: DataFrame, shortlist: int = 20) -> DataFrame:
    """Order of a list whose head was reordered: by place where there is one, the rest after it by score."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("place", F.lit(shortlist)), F.desc("score"), "dataset", "motion_id", "object_id")))


def pooled(score: Column, best: Column) -> Column:
    """Score as a share of the best one, 0 where that is 0."""
    return F.coalesce(F.round(score / F.nullif(best, F.lit(0.0)), 6), F.lit(0.0))


def sort_columns(sort: str, scored: bool) -> list[Column]:
    if sort == "frame_count_desc":
        return [F.desc(F.coalesce("frame_count", F.lit(0))), F.asc("dataset"), F.asc("motion_id"), F.asc("object_id")]
    if sort != "motion_id" and scored:
        return [F.desc(F.coalesce("score", F.lit(0.0))), F.asc("dataset"), F.asc("motion_id"), F.asc("object_id")]
    return [F.asc("dataset"), F.asc("motion_id"), F.asc("object_id")]


def page(rows: DataFrame, *, sort: str = "relevance", offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of rows (TakeOrderedAndProject); limits are clamped to 1..100."""
    return rows.orderBy(*sort_columns(sort, "score" in rows.columns)).offset(max(int(offset), 0)).limit(min(max(int(limit), 1), 100))
