"""What callers are shown: entries in full, compact and as search items, lookups, and readers of such responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import bounded

API = "/api/v1"
GLB_TYPE = "model/gltf-binary"
#: Ids of one lookup are a request; more of them are an error.
MOST_IDS = 100_000


def absolute(path: Column | str, base: str) -> Column:
    """A path as an address below a base; one that is an address already stays, a blank one gives null."""
    p = F.col(path) if isinstance(path, str) else path
    joined = F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(p, "^/+", ""))
    return F.when(p.rlike("^https?://"), p).when(F.length(p) > 0, joined)


def relative(path: Column, root: str) -> Column:
    """A file path below a root; one that lies elsewhere stays as it is."""
    head = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(head)), F.substring(path, F.lit(len(head) + 1), F.length(path))).otherwise(path)


def glb_name() -> Column:
    name = F.regexp_extract("motion_id", "([^/]+)/*$", 1)
    return F.concat(F.when(name != "", name).otherwise(F.col("object_id")), F.lit(".glb"))


def _path(kind: str, suffix: str = "") -> Column:
    return F.concat(F.lit(f"{API}/{kind}/"), "object_id", F.lit(suffix))


def _scores(best: Column) -> list[Column]:
    pooled = F.when(F.coalesce(best, F.lit(0.0)) != 0, F.round(F.col("score") / best, 6)).otherwise(0.0)
    return [F.round("score", 6).alias("score"), pooled.alias("pooled_score")]


def compact(entry: DataFrame, *, model: bool = True, best: str | None = None) -> DataFrame:
    """Entry rows of a page; ``classification`` and, with ``best`` (a column), scores are carried if they are there."""
    preview = F.struct(F.lit(True).alias("available"), _path("previews", ".webp").alias("download_path"), F.lit(0.0).alias("rotation_degrees"))
    columns = ["object_id", "dataset", "motion_id", "description", "captions", "frame_count", preview.alias("preview")]
    columns += ["classification"] if "classification" in entry.columns else []
    columns += _scores(F.col(best)) if best else []
    if model:
        columns.append(F.struct(_path("models").alias("rest_download_path"), glb_name().alias("filename"), F.lit(True).alias("available"), F.lit(True).alias("lazy")).alias("model"))
    return entry.select(*columns)


def full(entry: DataFrame, base: str, *, model: bool = True, best: str | None = None) -> DataFrame:
    """One entry with all its fields and links. ``preview_path``, ``canonical`` and ``rotation`` say what is known of its preview."""
    known = {c: F.col(c) if c in entry.columns else F.lit(None) for c in ("preview_path", "canonical", "rotation", "caption_file")}
    here = _path("previews", ".webp")
    turned = F.when(F.coalesce(known["canonical"], F.lit(False)), 0.0).otherwise(F.coalesce(known["rotation"].cast("double"), F.lit(0.0)))
    preview = F.struct(known["preview_path"].isNotNull().alias("available"), here.alias("download_path"), absolute(here, base).alias("download_url"), turned.alias("rotation_degrees"))
    none = F.lit(None).cast("string")
    thumbnail = F.struct(F.lit(False).alias("available"), none.alias("download_path"), none.alias("rest_download_path"), none.alias("download_url"))
    links = F.struct(absolute(_path("entries"), base).alias("self"), absolute(_path("models"), base).alias("download"), none.alias("icon"), none.alias("thumbnail"))
    columns = [
        "object_id", "dataset", "motion_id", "description", "captions", "frame_count", "source_motion", known["caption_file"].cast("string").alias("caption_file"), preview.alias("preview"),
        F.col("dataset").alias("animal"), F.col("motion_id").alias("track_name"), F.col("description").alias("action_name"), F.col("source_motion").alias("source_glb"),
        F.lit(None).cast("int").alias("frame_start"), F.lit(None).cast("int").alias("frame_end"), F.lit(False).alias("has_icon"), thumbnail.alias("thumbnail"), links.alias("_links"),
    ]
    columns += ["classification"] if "classification" in entry.columns else []
    columns += [*_scores(F.col(best)), none.alias("best_view_id"), none.alias("best_view_path")] if best else []
    if model:
        legacy = F.concat(F.lit("/models/"), "object_id")
        columns.append(
            F.struct(F.col("object_id").alias("sha256"), legacy.alias("download_path"), _path("models").alias("rest_download_path"), absolute(_path("models"), base).alias("download_url"), glb_name().alias("filename"), F.lit(True).alias("available"), F.lit(True).alias("lazy")).alias("model")
        )
    return entry.select(*columns)


def search_items(ranked: DataFrame, base: str, best: str) -> DataFrame:
    """Result rows of a search: rank, scores, the entry's short form, and addresses of model and preview."""
    url = absolute(_path("models"), base)
    known = {c: F.col(c) if c in ranked.columns else F.lit(None) for c in ("preview_path", "canonical", "rotation")}
    turned = F.when(F.coalesce(known["canonical"], F.lit(False)), 0.0).otherwise(F.coalesce(known["rotation"].cast("double"), F.lit(0.0)))
    return ranked.select(
        "rank", *_scores(F.col(best)), "object_id", "dataset", "motion_id", "description", "frame_count",
        F.struct(url.alias("url"), glb_name().alias("filename"), F.lit(GLB_TYPE).alias("content_type"), F.lit(True).alias("lazy")).alias("glb"),
        F.struct(absolute(_path("previews", ".webp"), base).alias("url"), known["preview_path"].isNotNull().alias("available"), turned.alias("rotation_degrees")).alias("preview"),
        F.struct(url.alias("download_url"), _path("models").alias("rest_download_path"), glb_name().alias("filename"), F.lit(True).alias("available"), F.lit(True).alias("lazy")).alias("model"),
    )


def lookup(entry: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Entries of the given ids; an id that no entry has gives no row. Few ids are a filter of the scan, more a broadcast join."""
    wanted = sorted(set(ids))
    if len(wanted) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids in a lookup")
    if len(wanted) <= 100:
        return entry.where(F.col("object_id").isin(*wanted)) if wanted else entry.limit(0)
    spark: SparkSession = entry.sparkSession
    return entry.join(bounded(spark.createDataFrame([(i,) for i in wanted], "object_id string"), MOST_IDS), "object_id", "left_semi")


# ---- readers of responses ----
_ITEM = """struct<object_id: string, rank: int, score: double, dataset: string, motion_id: string, description: string, glb: struct<url: string>,
model: struct<download_url: string, rest_download_path: string, download_path: string>, _links: struct<download: string>>"""
_RESPONSE = f"struct<items: array<{_ITEM}>, results: array<{_ITEM}>, data: array<{_ITEM}>>"


def response_items(responses: DataFrame, body: str = "body") -> DataFrame:
    """Result rows of JSON responses: their ``items``, else ``results``, else ``data``; a response with none is an error.

    The other columns of a row are kept with each of its results.
    """
    told = F.from_json(body, _RESPONSE)
    listed = responses.withColumn("_list", F.coalesce(told["items"], told["results"], told["data"]))
    held = listed.withColumn("_list", F.when(F.col("_list").isNotNull(), F.col("_list")).otherwise(F.raise_error(F.lit("a response without items, results or data"))))
    return held.select(*[c for c in responses.columns if c != body], F.inline("_list"))


def download_url(base: str) -> Column:
    """Address of the model of a result row: its scene's, else the model's in three forms, else its link."""
    return F.coalesce(
        absolute(F.col("glb")["url"], base), absolute(F.col("model")["download_url"], base), absolute(F.col("model")["rest_download_path"], base), absolute(F.col("model")["download_path"], base), absolute(F.col("_links")["download"], base)
    )
