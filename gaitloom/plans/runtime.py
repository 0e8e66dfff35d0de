"""What every plan needs from the session: tables, shared storage, sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    A temporary folder is made and set only where the session names none and all executors are threads of this process, as
    in tests; anywhere else a session without that setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="gaitloom-")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get()


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def clean_up() -> None:
    """Remove what ``materialize`` wrote in this process, as far as its session still lives."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001
            return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, keeps column pruning for the readers
    (unlike ``checkpoint``), and lets several consumers share one Python pass. The files go when the process ends or
    ``clean_up`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for a broadcast, after counting that it has at most so many rows; more are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a table of more than {most} rows can't be broadcast")
    return broadcast(df)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are task slots.

    For costly per-row work over a few files or row groups. Where the scan already gives every slot work, as any
    large table does, nothing is moved. A plan whose partitions can't be told before it runs is left alone.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    try:
        there = df._jdf.queryExecution().sparkPlan().execute().getNumPartitions()
    except Exception:  # noqa: BLE001
        return df
    return df.repartition(slots) if 0 < there < slots else df
