"""Checks of previews and rows, shards, samples and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from ..sources.files import little_endian


def quick_issue(content: Column) -> Column:
    """Issue of a preview file by size and signature; null for a usable one."""
    return F.when(content.isNull(), "missing").when(F.length(content) < 16, "empty").when((F.substring(content, 1, 4) != F.lit(b"RIFF")) | (F.substring(content, 9, 4) != F.lit(b"WEBP")), "invalid_format")


def cascade(*steps: tuple[Column, str]) -> Column:
    """First issue whose condition holds."""
    out = F.when(F.lit(False), "")
    for condition, issue in steps:
        out = out.when(condition, issue)
    return out


def preview_issue(decoded: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Full cascade over decoded features: missing, empty, corrupt, invalid_format, wrong_dimensions, blank.

    ``decoded`` holds ``length, readable, format, width, height, channel_range, foreground_ratio``.
    """
    wrong = F.lit(False)
    if width is not None:
        wrong = wrong | (F.col("width") != width)
    if height is not None:
        wrong = wrong | (F.col("height") != height)
    issue = cascade(
        (F.col("length").isNull(), "missing"),
        (F.col("length") == 0, "empty"),
        (~F.coalesce("readable", F.lit(False)), "corrupt"),
        (F.col("format") != "WEBP", "invalid_format"),
        (wrong, "wrong_dimensions"),
        ((F.col("channel_range") < 12) | (F.col("foreground_ratio") < 0.02), "blank"),
    )
    return decoded.withColumn("issue", issue)


def issue_counts(rows: DataFrame, issue: str = "issue") -> DataFrame:
    return rows.groupBy(F.coalesce(issue, F.lit("ok")).alias("issue")).agg(F.count("*").alias("n"))


def issue_samples(rows: DataFrame, order: Sequence[str], size: int = 50) -> DataFrame:
    return rows.where("issue IS NOT NULL").orderBy(*order).limit(size)


def shard(rows: DataFrame, order: Sequence[str], index: int, count: int) -> DataFrame:
    """Every count-th row of an order, from ``index`` on.

    Places come from per-partition counts after a range sort, so no single task numbers all rows. The sorted rows are
    written once, and both the counts and the places are read from that table.
    """
    sorted_ = materialize(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)), "sharded")
    sizes = sorted_.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = sorted_.join(F.broadcast(before.select("_p", "_from")), "_p")
    return placed.where(F.pmod(F.col("_from") + F.col("_i"), F.lit(count)) == index).drop("_p", "_i", "_from")


def known_and_unknown(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the given ids, and the ids that no row has."""
    return rows.join(ids, "object_id", "left_semi"), ids.join(rows.select("object_id"), "object_id", "left_anti")


def running_total(rows: DataFrame, by: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Cumulative sum within groups."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("cumulative", F.sum(value).over(w))


# ---- previews ----
def preview_paths(entry: DataFrame, root: str) -> DataFrame:
    """Entries with the path of their preview and that of its older form."""
    stem = F.concat_ws("/", F.lit(root.rstrip("/")), "dataset", "motion_id")
    return entry.withColumn("canonical_path", F.concat(stem, F.lit(".webp"))).withColumn("legacy_path", F.concat(stem, F.lit(".png")))


def resolve_previews(entry: DataFrame, files: DataFrame, root: str, least: int = 16) -> DataFrame:
    """Entries with ``preview_path``: the preview if a usable file is there, else the older form, else null.

    ``files`` is ``(path, length[, issue])`` of a scan; a file counts as usable from ``least`` bytes on and without an issue.
    """
    sound = files.where(F.col("length") >= least)
    sound = (sound.where("issue IS NULL") if "issue" in files.columns else sound).select(F.regexp_replace("path", "^file:/*(?=/)|^file:", "").alias("path")).distinct()
    told = preview_paths(entry, root)
    new = told.join(sound.select(F.col("path").alias("canonical_path"), F.lit(True).alias("has_new")), "canonical_path", "left")
    both = new.join(sound.select(F.col("path").alias("legacy_path"), F.lit(True).alias("has_old")), "legacy_path", "left")
    return both.withColumn("preview_path", F.when(F.col("has_new"), F.col("canonical_path")).when(F.col("has_old"), F.col("legacy_path"))).drop("has_new", "has_old", "legacy_path", "canonical_path")


def preview_candidates(entry: DataFrame, files: DataFrame, root: str, *, dataset: str = "all", ids: Sequence[str] = (), index: int = 0, count: int = 1, overwrite: bool = False) -> DataFrame:
    """Entries whose preview has to be made: of a dataset, of the given ids, of one shard, and without a usable file.

    The shard is dealt over the eligible entries in the order of dataset and motion, before missing files are sought.
    """
    eligible = entry if dataset == "all" else entry.where(F.col("dataset") == dataset)
    if ids:
        eligible = eligible.where(F.col("object_id").isin(*ids))
    if count > 1:
        eligible = shard(eligible, ["dataset", "motion_id", "object_id"], index, count)
    if overwrite:
        return eligible
    return resolve_previews(eligible, files, root).where(F.col("preview_path").isNull() | F.endswith("preview_path", F.lit(".png"))).drop("preview_path")


def webp_size(content: Column) -> Column:
    """``struct<width, height>`` of an image file by the header of its first chunk; null for anything else."""
    low = lambda at, n: little_endian(content, at, n).cast("int")
    kind = F.substring(content, 13, 4)
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    lossless = little_endian(content, 21, 4)
    return F.when(
        quick_issue(content).isNull() & (F.length(content) >= 30),
        F.when(kind == F.lit(b"VP8X"), size(low(24, 3) + 1, low(27, 3) + 1))
        .when(kind == F.lit(b"VP8 "), size(low(26, 2).bitwiseAND(0x3FFF), low(28, 2).bitwiseAND(0x3FFF)))
        .when(kind == F.lit(b"VP8L"), size((lossless.bitwiseAND(0x3FFF) + 1).cast("int"), (F.shiftright(lossless, 14).bitwiseAND(0x3FFF) + 1).cast("int"))),
    )


def migration_tally(outcomes: DataFrame) -> DataFrame:
    """``(converted, removed, failed)`` of a run over files: ``outcomes`` is ``(path, converted, removed, error)``."""
    done = lambda c: F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col(c)).otherwise(0)), F.lit(0))
    return outcomes.agg(done("converted").alias("converted"), done("removed").alias("removed"), F.count_if(F.length("error") > 0).alias("failed"))
