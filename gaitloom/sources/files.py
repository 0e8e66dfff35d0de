"""Asset directories as tables: caption files, motion files and their headers."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

HEADER_LIMIT = 1 << 20


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def caption_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, stem, captions)``: one caption a line, marks and blanks dropped, broken bytes replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    body = F.regexp_replace(F.decode("content", "UTF-8"), "^\\ufeff", "")
    lines = F.filter(F.transform(F.split(body, "\r\n|\r|\n"), X.squeeze), lambda line: line != "")
    return raw.select("path", stem(F.col("path")).alias("stem"), lines.alias("captions"))


def motion_files(spark: SparkSession, path: str, glob: str, content: bool = False) -> DataFrame:
    """``(path, stem, length[, content])`` of the files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    columns = ["path", stem(F.col("path")).alias("stem"), "length"]
    return raw.select(*columns, "content") if content else raw.select(*columns)


def numeric_order(name: Column) -> list[Column]:
    """Numbers first in their order, then other stems by text."""
    number = name.rlike("^[0-9]+$")
    return [F.desc(number), F.asc(F.when(number, name.cast("bigint"))), F.asc(name)]


def paired_folders(files: DataFrame, names: tuple[str, ...] = ("P1.npz", "P2.npz")) -> DataFrame:
    """Folders that hold all the named files."""
    named = files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    return named.groupBy("folder").agg(*[F.bool_or(F.col("name") == n).alias(f"has_{k}") for k, n in enumerate(names)]).where(" AND ".join(f"has_{k}" for k in range(len(names)))).select("folder")


def with_captions(motions: DataFrame, captions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Motions joined with their captions, and the motions that have none (for warnings)."""
    given = captions.where(F.size("captions") > 0).select("stem", "captions")
    return motions.join(given, "stem"), motions.join(given, "stem", "left_anti")


def little_endian(content: Column, at: int, size: int) -> Column:
    """Whole number of some bytes of a file, the lowest first (places count from 0)."""
    digits = F.hex(F.substring(content, at + 1, size))
    return F.conv(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]), 16, 10).cast("bigint")


def npy_header(content: Column) -> Column:
    """``struct<type, fortran, frames, start>`` of an array file: what its header says, and where the data begin.

    Null for anything else. The header is the literal of a dictionary with three fixed keys, so patterns read it.
    """
    wide = F.substring(content, 7, 1) != F.lit(b"\x01")
    begin = F.when(wide, 12).otherwise(10)
    size = F.when(wide, little_endian(content, 8, 4)).otherwise(little_endian(content, 8, 2))
    whole = (F.substring(content, 1, 6) == F.lit(b"\x93NUMPY")) & (size <= HEADER_LIMIT) & (F.length(content) >= begin + size)
    said = F.decode(F.substring(content, begin + 1, size.cast("int")), "ISO-8859-1")
    dims = F.regexp_extract(said, r"'shape'\s*:\s*\(\s*(\d+)", 1)
    return F.when(
        whole & (dims != ""),
        F.struct(F.regexp_extract(said, r"'descr'\s*:\s*'([^']*)'", 1).alias("type"), (F.regexp_extract(said, r"'fortran_order'\s*:\s*(\w+)", 1) == "True").alias("fortran"), dims.cast("bigint").alias("frames"), (begin + size).alias("start")),
    )


def npy_frame_count(content: Column | str) -> Column:
    """First dimension of an array file; null for anything else."""
    frames = npy_header(F.col(content) if isinstance(content, str) else content)["frames"]
    return F.when(frames.between(1, 2**31 - 1), frames.cast("int"))


_SCENE = "accessors array<struct<count: bigint>>, animations array<struct<samplers: array<struct<input: int>>>>"


def glb_frame_count(content: Column | str) -> Column:
    """Largest sample count over the inputs of all animation samplers of a binary scene file; null for anything else.

    The first chunk of a scene of version 2 is its JSON; only these bytes are decoded, and only the two lists are parsed.
    """
    c = F.col(content) if isinstance(content, str) else content
    sound = (F.substring(c, 1, 4) == F.lit(b"glTF")) & (little_endian(c, 4, 4) == 2) & (F.substring(c, 17, 4) == F.lit(b"JSON")) & (F.length(c) >= 20 + little_endian(c, 12, 4))
    scene = F.from_json(F.when(sound, F.decode(F.substring(c, F.lit(21), little_endian(c, 12, 4).cast("int")), "UTF-8")), _SCENE)
    inputs = F.flatten(F.transform(scene["animations"], lambda a: F.transform(F.coalesce(a["samplers"], F.array()), lambda s: s["input"])))
    counts = F.transform(F.filter(inputs, lambda i: i >= 0), lambda i: F.get(scene["accessors"], i)["count"])
    return F.array_max(F.filter(counts, lambda n: n > 0)).cast("int")


def npz_frames(data: bytes | None, member: str = "root_orient") -> int | None:
    """First dimension of one array of an archive; null where it has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as archive, archive.open(f"{member}.npy") as part:
            version = np.lib.format.read_magic(part)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape = read(part)[0]
    except (OSError, KeyError, ValueError, zipfile.BadZipFile):
        return None
    return int(shape[0]) if shape and shape[0] > 0 else None


@F.pandas_udf(T.IntegerType())
def npz_frame_count(content: pd.Series) -> pd.Series:
    """Frames of the root orientation in an archive; the archive's directory is at its end, so Python reads it."""
    return content.map(npz_frames).astype("Int32")


def roll_degrees(x: Column, y: Column, z: Column) -> Column:
    """Preview roll of an axis-angle root rotation; magnitudes below 8 degrees count as none."""
    angle = F.sqrt(x * x + y * y + z * z)
    s, c = F.sin(angle), F.cos(angle)
    up_x = F.when(angle < 1e-8, 0.0).otherwise(-z / angle * s + x / angle * (y / angle) * (1.0 - c))
    up_z = F.when(angle < 1e-8, 0.0).otherwise(x / angle * s + z / angle * (y / angle) * (1.0 - c))
    roll = -F.degrees(F.atan2(up_x, up_z))
    return F.when((angle < 1e-8) | (F.abs(roll) < 8.0), 0.0).otherwise(F.round(roll, 2))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _first_floats(bytes_: pd.Series, type_: pd.Series) -> pd.Series:
    """Three single-precision numbers of twelve bytes."""
    return pd.Series([np.frombuffer(b, ">f4" if t == ">f4" else "<f4").astype(float).tolist() if b is not None and len(b) == 12 else None for b, t in zip(bytes_, type_)])


def npy_preview_roll(content: Column | str) -> Column:
    """Roll of the first three numbers of an array file; 0 for anything unreadable. Only twelve bytes leave the JVM."""
    c = F.col(content) if isinstance(content, str) else content
    head = npy_header(c)
    usable = ~head["fortran"] & head["type"].isin("<f4", ">f4", "=f4", "|f4")
    first = _first_floats(F.when(usable, F.substring(c, (head["start"] + 1).cast("int"), F.lit(12))), F.coalesce(head["type"], F.lit("")))
    return F.coalesce(roll_degrees(first[0], first[1], first[2]), F.lit(0.0))


def lazy_frames(stored: Column, dataset: Column, read: Column, datasets: tuple[str, ...] = ("motionxpp", "motionlab")) -> Column:
    """Stored frame count, or the one read from the file for the two datasets that allow it."""
    return F.coalesce(stored, F.when(dataset.isin(*datasets), read))


def index_records(motions: DataFrame, dataset: str, *, motion_id: Column | str = "stem", frame_count: Column | None = None) -> DataFrame:
    """Index rows of captioned motions of one dataset, with their hash ids."""
    m = F.col(motion_id) if isinstance(motion_id, str) else motion_id
    return motions.select(
        F.lit(dataset).alias("dataset"),
        m.alias("motion_id"),
        F.col("path").alias("source_motion"),
        "captions",
        F.get("captions", F.lit(0)).alias("description"),
        F.sha2(F.concat_ws(":", F.lit(dataset), m, F.col("path")), 256).alias("object_id"),
        (frame_count if frame_count is not None else F.lit(None).cast("int")).alias("frame_count"),
    )
