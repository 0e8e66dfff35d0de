"""JSON-lines inputs with declared schemas; broken syntax fails the read, unknown fields are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..plans.runtime import bounded


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: Bits of a row number below the number of its file; a file holds fewer bytes than that.
FILE_BITS = 42
#: Pieces of files are listed for a broadcast; more of them are an error.
MOST_PIECES = 10_000_000


def numbered(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """Lines with a number that grows with the name of the file and the place in it, and ``_broken`` text where a line is none.

    Files may be split and packed into partitions in any order: a piece of a file begins at a byte, a line adds at least
    one, so byte plus line of the piece never goes back.
    """
    raw = spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    read = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    pieces = bounded(read.groupBy("_file", "_start").agg(F.min("_row").alias("_first")).withColumn("_no", F.dense_rank().over(Window.orderBy("_file"))), MOST_PIECES)
    number = F.shiftleft(F.col("_no").cast("bigint"), FILE_BITS) + F.col("_start") + F.col("_row") - F.col("_first")
    return read.join(pieces, ["_file", "_start"]).withColumn(name, number).drop("_start", "_row", "_first", "_no")


def _sound(rows: DataFrame, number: str, wanted: str) -> DataFrame:
    """``rows`` that meet a condition, without broken lines: one of them, or none left, is an error that names the place."""
    seen = rows.agg(F.count_if(F.expr(wanted)).alias("n"), F.min(F.when(F.col("_broken").isNotNull(), F.struct(number, "_file", "_broken"))).alias("bad")).first()
    if seen.bad is not None:
        line = seen.bad[number] % (1 << FILE_BITS) + 1
        raise ValueError(f"{seen.bad._file}:{line}: not a JSON object: {seen.bad._broken[:200]}")
    if not seen.n:
        raise ValueError("no usable row")
    return rows.where(wanted).drop("_broken", "_file")


def asset_index(spark: SparkSession, path: str) -> DataFrame:
    """Asset index with a ``record_id`` that grows with file and line order; rows without required fields are dropped.

    A line that is no JSON object is an error that names its file and, in files read in one piece, its line.
    """
    rows = numbered(spark, path, schemas.INDEX, "record_id")
    return _sound(rows, "record_id", "trim(coalesce(dataset, '')) <> '' AND trim(coalesce(motion_id, '')) <> ''")


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """Assignments; the last row of an object holds (order of files and lines)."""
    rows = _sound(numbered(spark, path, schemas.ASSIGNMENTS, "line_no"), "line_no", "object_id <> ''")
    return rows.groupBy("object_id").agg(F.max_by("classification", "line_no").alias("classification"))


def classification_entries(spark: SparkSession, path: str) -> DataFrame:
    """Index rows with an object id and trimmed, non-blank captions, as the classifier reads them."""
    rows = _lines(spark, path, schemas.INDEX).where("trim(object_id) <> ''")
    return rows.withColumn("captions", F.filter(F.transform("captions", lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), lambda c: c != ""))


def cases(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    rows = _lines(spark, path, schemas.CASES)
    return rows if split == "all" else rows.where(F.col("split") == split)


def dense_rows(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Caption vectors; the number of rows is held against the manifest's."""
    rows = spark.read.schema(schemas.CAPTIONS).parquet(path)
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{path} has {n} rows, the manifest {expected}")
    return rows


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOG).option("multiLine", True).json(path).select(F.inline("nodes"))


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SOURCE_TREE).option("multiLine", True).json(path).select(F.inline("taxonomy"))


def sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SOURCES).option("multiLine", True).json(path).select(F.inline("sources"))
