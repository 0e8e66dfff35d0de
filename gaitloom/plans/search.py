"""Ranked text search: one request or a batch, lexical, dense or hybrid, with rerank, diversity and sampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import has_han
from ..functions.requests import encoder_texts, semantic_text
from ..operators import ranking as R
from ..operators.postings import Index

#: Texts -> vectors; an encoder model stands behind it, tests use stored vectors.
Encoder = Callable[[list[str]], list[Sequence[float]]]


@dataclass(frozen=True)
class Request:
    text: str
    top_k: int = 5
    candidate_k: int = 200
    mode: str = "hybrid"
    rerank: bool = True
    diversity: bool = True
    randomness: float = 0.0
    seed: str = "0"
    shortlist: int = 20
    warnings: list[str] = field(default_factory=list)


class BadRequest(ValueError):
    pass


def checked(request: Request, dense_available: bool) -> Request:
    """Request with bounds applied and warnings for what was turned off."""
    if request.mode not in ("lexical", "semantic", "hybrid"):
        raise BadRequest(f"unknown mode {request.mode}")
    warnings = list(request.warnings)
    mode, rerank, diversity = request.mode, request.rerank, request.diversity
    if mode != "lexical" and not dense_available:
        mode = "lexical"
        warnings.append("no dense index: lexical ranking")
    if rerank and has_han(request.text):
        rerank = diversity = False
        warnings.append("reranking and diversity are off for Han text")
    k = min(max(request.top_k, 1), 100)
    return Request(request.text, k, max(request.candidate_k, k), mode, rerank, diversity, request.randomness, request.seed, request.shortlist, warnings)


def search(index: Index | DataFrame, request: Request, *, captions: DataFrame | None = None, encode: Encoder | None = None, scorer=R.overlap_score) -> tuple[DataFrame, list[str]]:
    """``(object_id, dataset, motion_id, score, pooled_score, position)`` of one request, and its warnings.

    ``index`` is a published index or the entry table, ``captions`` the caption vectors. A lexical search scores the
    candidates of the full-text order only, the expensive scorer sees the shortlist only.
    """
    entry = index.entry if isinstance(index, Index) else index
    spark: SparkSession = entry.sparkSession
    r = checked(request, captions is not None and encode is not None)
    terms = R.query_table(spark, [("q", r.text)]) if r.mode != "semantic" else None
    wanted = max(r.candidate_k, r.top_k)
    lexical = R.lexical_top(R.lexical_scores(index, terms, limit=R.candidate_limit(wanted)), wanted) if terms is not None else None
    if r.mode == "lexical":
        ranked = lexical
    else:
        vectors = {"q": encode(encoder_texts(semantic_text(r.text)))}
        scored = R.dense_scores(captions.where("object_id IS NOT NULL"), vectors, keep=4 * wanted)
        dense = R.best_of_object(R.top(scored, 4 * wanted, [F.desc(F.round("score", 9)), F.asc("vec_id")]))
        if r.mode == "semantic":
            ranked = dense.join(entry.select("object_id", "dataset", "motion_id"), "object_id").select("query_id", "object_id", "dataset", "motion_id", "score")
        else:
            ranked = R.fuse(lexical, dense, entry).withColumn("score", F.col("fused")).select("query_id", "object_id", "dataset", "motion_id", "score")
        ranked = R.lexical_top(ranked, wanted)
    if r.rerank or r.diversity:
        head = ranked.where(F.col("rank") <= r.shortlist).join(entry.drop("dataset", "motion_id"), "object_id").withColumn("query", F.lit(r.text)).withColumn("base_score", F.col("score"))
        if r.rerank:
            head = R.rerank(head, scorer).withColumn("score", F.col("reranker_score"))
        head = R.lexical_top(head.drop("rank"), r.shortlist)
        places = R.diversify(head) if r.diversity else head.select("query_id", "object_id", F.col("rank").alias("place"))
        rest = ranked.drop("rank").withColumnRenamed("score", "base")
        joined = rest.join(places, ["query_id", "object_id"], "left").join(head.select("query_id", "object_id", "score"), ["query_id", "object_id"], "left")
        ranked = R.merge_reranked(joined.withColumn("score", F.coalesce("score", "base")).drop("base"), r.shortlist).withColumn("rank", F.col("position")).drop("place", "position")
    best = F.expr("max(score) OVER (PARTITION BY query_id)")
    drawn = R.sample(ranked.withColumn("best", best), r.top_k, r.randomness, r.seed)
    return drawn.select("object_id", "dataset", "motion_id", "score", R.pooled(F.col("score"), F.col("best")).alias("pooled_score"), F.col("place").alias("position")), r.warnings
