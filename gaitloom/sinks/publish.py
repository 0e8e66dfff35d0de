"""Publishing whole versions: data first, the pointer last, so a reader never sees half of one."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small driver-side file by renaming a complete new one over it.

    The rename replaces the target in one step, so a reader finds the old file or the new one, never none.
    """
    fs, target, jvm = _filesystem(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = jvm.org.apache.hadoop.fs.Options
    over = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    over[0] = getattr(options, "Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), over)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, target, _ = _filesystem(spark, path)
    if not fs.exists(target):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


def publish(df: DataFrame, root: str, manifest: dict | None = None, partition_by: tuple[str, ...] = ()) -> str:
    """Write a new version below ``root``, then its manifest, which names it as the current one."""
    version = uuid.uuid4().hex
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{version}")
    write_text(df.sparkSession, f"{root}/manifest.json", json.dumps({**(manifest or {}), "version": version}, ensure_ascii=False))
    return version


def current(spark: SparkSession, root: str) -> tuple[DataFrame, dict]:
    """The current version and its manifest."""
    said = read_text(spark, f"{root}/manifest.json")
    if said is None:
        raise FileNotFoundError(f"{root} has no published version")
    manifest = json.loads(said)
    return spark.read.parquet(f"{root}/{manifest['version']}"), manifest


def amend_manifest(spark: SparkSession, root: str, **fields) -> None:
    """Add fields, such as calibrated thresholds, to the manifest of the current version."""
    write_text(spark, f"{root}/manifest.json", json.dumps({**json.loads(read_text(spark, f"{root}/manifest.json") or "{}"), **fields}, ensure_ascii=False))


def fingerprint(spark: SparkSession, path: str, *more) -> str:
    """Hash of the names, sizes and times of the files below a path, and of whatever else the result depends on."""
    fs, place, _ = _filesystem(spark, path)
    found = []
    if fs.exists(place):
        files = fs.listFiles(fs.makeQualified(place), True)
        while files.hasNext():
            one = files.next()
            found.append(f"{one.getPath()}:{one.getLen()}:{one.getModificationTime()}")
    return hashlib.sha256("\n".join([*sorted(found), *map(str, more)]).encode()).hexdigest()


def ensure(build, spark: SparkSession, root: str, fingerprint: str) -> DataFrame:
    """The published table if its fingerprint is this one (a hash of inputs and rules), else a new version of it."""
    said = read_text(spark, f"{root}/manifest.json")
    if said is None or json.loads(said).get("fingerprint") != fingerprint:
        publish(build(), root, {"fingerprint": fingerprint})
    return current(spark, root)[0]


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines without null fields dropped, non-ASCII kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def report(df: DataFrame, limit: int = 100_000) -> list[dict]:
    """Rows of a bounded report for the driver; more than ``limit`` rows are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    return [r.asDict(recursive=True) for r in rows]
