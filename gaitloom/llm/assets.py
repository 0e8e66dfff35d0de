"""The asset view two problems share: normalised dataset and the classification row in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dataset_key(column: str | Column = "dataset") -> Column:
    """Trimmed of all white space, in lower case; blank becomes null."""
    name = F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"(?U)^\s+|\s+$", ""))
    return F.when(name != "", name)


def in_force(motion_entry: DataFrame) -> DataFrame:
    """``(object_id, series_key, action_category)`` of the row in force: latest classified_at, then highest entry_no.

    A null classified_at is older than any other. The two strings are extracted before the aggregation, so
    nothing wide is shuffled, and the aggregation is combined on the map side whatever the skew.
    """
    row = motion_entry.where(F.col("object_id").isNotNull()).select(
        "object_id",
        F.struct("classified_at", "entry_no", F.coalesce("series_key", F.lit("")).alias("series_key"), F.col("classification.taxonomy").getItem("action_category").alias("action_category")).alias("r"),
    )
    return row.groupBy("object_id").agg(F.max("r").alias("r")).select("object_id", "r.series_key", "r.action_category")
