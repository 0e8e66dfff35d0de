"""Inverted index tables: postings, document lengths, document frequencies and corpus statistics."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.runtime import materialize, shared_dir
from ..sinks import publish as K


def indexed(entry: DataFrame, text_col: str = "search_text") -> DataFrame:
    """Entries with their ``tokens``, written once: the table every other index table and every search is read from."""
    return materialize(entry.withColumn("tokens", X.tokens(text_col)), "indexed")


def tokens_of(entry: DataFrame, text_col: str = "search_text") -> Column:
    """The stored tokens of an indexed table, else those of its text."""
    return F.col("tokens") if "tokens" in entry.columns else X.tokens(text_col)


def postings(entry: DataFrame, id_col: str = "object_id", text_col: str = "search_text") -> DataFrame:
    """``(id, token, tf)``; the count is combined on the map side, and a document is never gathered."""
    return entry.select(id_col, F.explode(tokens_of(entry, text_col)).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("tf"))


def document_lengths(posting: DataFrame, id_col: str = "object_id") -> DataFrame:
    return posting.groupBy(id_col).agg(F.sum("tf").alias("dl"))


def token_lengths(entry: DataFrame, id_col: str = "object_id", text_col: str = "search_text") -> DataFrame:
    """Document lengths straight from the text: no shuffle."""
    return entry.select(id_col, F.size(tokens_of(entry, text_col)).cast("bigint").alias("dl"))


def idf(posting: DataFrame, documents: int, id_col: str = "object_id") -> DataFrame:
    """``(token, df, idf)`` with idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    n = F.lit(float(max(documents, 1)))
    counted = posting.groupBy("token").agg(F.count("*").alias("df"))
    return counted.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


#: Buckets of a published postings table; a search reads those of its tokens only.
BUCKETS = 64
#: Version of the token rules; part of the fingerprint of an index.
RULES = "1"


@dataclass(frozen=True)
class Index:
    """What a search reads: entries, postings with the length of their document in the row, and the corpus statistics."""

    entry: DataFrame
    postings: DataFrame
    documents: int
    mean_length: float
    bucketed: bool = False

    def hits(self, tokens: list[str]) -> DataFrame:
        """Postings of a bounded set of tokens."""
        held = self.postings.where(F.col("token").isin(*tokens))
        if self.bucketed:
            held = held.where(F.col("bucket").isin(*sorted({bucket_of(t) for t in tokens})))
        return held.select("object_id", "token", "tf", "dl")


def bucket_of(token: str) -> int:
    """Bucket of a token (the same on the driver and in SQL)."""
    return zlib.crc32(token.encode()) % BUCKETS


def _with_lengths(entry: DataFrame) -> DataFrame:
    tokens = entry.select("object_id", tokens_of(entry).alias("tokens"))
    each = tokens.select("object_id", F.size("tokens").cast("bigint").alias("dl"), F.explode("tokens").alias("token"))
    return each.groupBy("object_id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def unpublished(entry: DataFrame) -> Index:
    """The index of entries that are read once: tokens are dropped inside the row, before anything is shuffled."""
    n, mean = token_lengths(entry).agg(F.count("*"), F.avg("dl")).first()
    return Index(entry, _with_lengths(entry), max(int(n or 0), 1), max(float(mean or 0.0), 1.0))


def publish_index(spark: SparkSession, root: str, fingerprint: str, build: Callable[[], DataFrame]) -> Index:
    """The index below ``root`` if its fingerprint is this one, else a new version of it.

    Entries are tokenised once; postings lie in buckets by token, sorted by it, so a search prunes folders by bucket and row
    groups by token; the statistics stand in the manifest.
    """
    told = K.read_text(spark, f"{root}/manifest.json")
    manifest = json.loads(told) if told else {}
    if manifest.get("fingerprint") != fingerprint:
        version = uuid.uuid4().hex
        build().withColumn("tokens", X.tokens("search_text")).write.parquet(f"{root}/{version}/entries")
        entry = spark.read.parquet(f"{root}/{version}/entries")
        rows = _with_lengths(entry).withColumn("bucket", F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(BUCKETS)).cast("int"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{root}/{version}/postings")
        n, mean = token_lengths(entry).agg(F.count("*"), F.avg("dl")).first()
        manifest = {"fingerprint": fingerprint, "version": version, "documents": max(int(n or 0), 1), "mean_length": max(float(mean or 0.0), 1.0)}
        K.write_text(spark, f"{root}/manifest.json", json.dumps(manifest))
    base = f"{root}/{manifest['version']}"
    postings = spark.read.schema("object_id string, token string, tf bigint, dl bigint, bucket int").parquet(f"{base}/postings")
    return Index(spark.read.parquet(f"{base}/entries").drop("tokens"), postings, manifest["documents"], manifest["mean_length"], True)


def ensure_index(spark: SparkSession, source: str, build: Callable[[], DataFrame], root: str | None = None) -> Index:
    """The published index of a source; it is built where the files of the source or the rules are not those it was built of."""
    mark = K.fingerprint(spark, source, RULES, BUCKETS)
    return publish_index(spark, root or f"{shared_dir(spark).rstrip('/')}/index-{mark[:32]}", mark, build)
