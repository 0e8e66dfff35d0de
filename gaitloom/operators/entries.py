"""Index rows as typed entries, caption rows for the dense index, and the classification in force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.runtime import spread


def entries(motion_index: DataFrame) -> DataFrame:
    """One row per asset: coerced fields, kept captions, derived title, series key and search text.

    Rows without dataset, motion id or object id (which falls back to a hash) are dropped. Of several rows of
    one object the last loaded line (highest record_id) holds; the aggregation is combined on the map side.
    """
    d = F.lower(X.squeeze("dataset"))
    m = X.squeeze("motion_id")
    given = X.squeeze("object_id")
    captions = X.searchable_captions("captions")
    told = X.squeeze("description")
    first = F.when(F.size(captions) > 0, captions[0]).otherwise("")
    row = spread(motion_index.select("record_id", "dataset", "motion_id", "source_motion", "captions", "description", "object_id", "cache_glb", "frame_count")).select(
        "record_id",
        d.alias("dataset"),
        m.alias("motion_id"),
        F.coalesce("source_motion", F.lit("")).alias("source_motion"),
        captions.alias("captions"),
        F.when(F.length(told) > 0, told).otherwise(X.squeeze(first)).alias("description"),
        F.when(F.length(given) > 0, given)
        .when((F.length(d) > 0) & (F.length(m) > 0), F.sha2(F.concat_ws(":", d, m, F.coalesce("source_motion", F.lit(""))), 256))
        .otherwise("")
        .alias("object_id"),
        "cache_glb",
        F.when(F.col("frame_count") > 0, F.col("frame_count")).alias("frame_count"),
    ).where("dataset <> '' AND motion_id <> '' AND object_id <> ''")
    last = row.groupBy("object_id").agg(F.max_by(F.struct(*[c for c in row.columns if c != "object_id"]), "record_id").alias("r")).select("object_id", "r.*")
    title = X.motion_title("dataset", "motion_id")
    return last.withColumn("source_title", title).withColumn("series_key", X.series_key("dataset", "motion_id")).withColumn("search_text", X.squeeze(F.concat_ws(" ", F.array("dataset", "motion_id", "source_title", "description"), F.col("captions"))))


def caption_rows(motion_index: DataFrame) -> DataFrame:
    """``(record_id, object_id, caption, caption_rank, source_type)``: a title row (rank -1) and the kept captions.

    Of equal captions of a record the first stays, with its place in the original list. Records without captions
    give their description. Objects with a null or blank id give none.
    """
    base = motion_index.select("record_id", F.trim("object_id").alias("object_id"), F.coalesce("dataset", F.lit("")).alias("dataset"), F.coalesce("motion_id", F.lit("")).alias("motion_id"), "captions", "description").where("object_id <> ''")
    titles = base.withColumn("caption", X.motion_title("dataset", "motion_id")).where("caption <> ''").select("record_id", "object_id", "caption", F.lit(-1).alias("caption_rank"), F.lit("source_title").alias("source_type"))
    listed = F.when(F.size("captions") > 0, F.col("captions")).otherwise(F.array(F.coalesce("description", F.lit(""))))
    cleaned = F.transform(listed, lambda c, k: F.struct(X.clean_caption(c).alias("caption"), k.alias("caption_rank")))
    kept = F.filter(cleaned, lambda r: X.searchable(r["caption"]))
    # the first occurrence is found inside the row, in one fold over the cleaned captions, without a shuffle
    none = F.array().cast("array<struct<caption: string, caption_rank: int>>")
    first = F.aggregate(kept, none, lambda acc, r: F.when(F.exists(acc, lambda o: o["caption"] == r["caption"]), acc).otherwise(F.array_append(acc, r)))
    captions = base.select("record_id", "object_id", F.inline(first)).select("record_id", "object_id", "caption", "caption_rank", F.lit("caption").alias("source_type"))
    return titles.unionByName(captions)


def assignments(motion_entry: DataFrame) -> DataFrame:
    """``(object_id, series_key, classification)`` in force: latest classified_at, then highest entry_no."""
    order = F.struct(F.coalesce(F.col("classified_at"), F.lit("0001-01-01").cast(motion_entry.schema["classified_at"].dataType)), F.col("entry_no"))
    return motion_entry.where("object_id IS NOT NULL").groupBy("object_id").agg(F.max_by(F.struct("series_key", "classification"), order).alias("r")).select("object_id", "r.*")


def classified(entry: DataFrame, assigned: DataFrame) -> DataFrame:
    """Entries with their assignment or null; participants always follow the dataset."""
    return entry.join(assigned.select("object_id", "classification"), "object_id", "left")
