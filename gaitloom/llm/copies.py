"""Duplicates hidden by formatting differences (problem 1).

Method. Every (field name, normalised value) pair of a record is hashed to 128 bits, and the hashes are added
modulo 2**128: an additive multiset hash, so captions, and the parts of an attribute caption, may stand in any
order without being sorted. Records are grouped by this fingerprint with map-side combination, only the smallest
id of a group being kept; each other member is then held against the record with that id, by counting equal values.

Normal form of a text: Unicode compatibility composition, case folding, letters and digits only. A caption that
consists of ``name: value`` parts throughout is the multiset of its parts, a name and a value each; any other caption is
one value. Where a colon or an equals sign stands between names and values, the caption alone tells its parts, which
``; | / ,``, line ends or nothing may divide. Where formatting took these signs away, a part begins at a word that other
captions use as a name in front of a colon, followed by more than the one blank that divides words; these names are
counted over all captions, none is listed here.

Defined results: null, empty and letterless captions do not count; a null description equals a letterless one;
records without letters or digits in both fields are never copies; a caption that stands twice counts twice.
A member that fails the comparison (a 128-bit collision) stays a record of its own. Null record ids take no part.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import materialize, spread

#: Groups with more than this share of all records are split over several tasks; there are at most 1 / share of them.
HOT_SHARE = 0.001

_WORD = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[\W_]+")
_SIGN = re.compile(r"[:=]")
_BETWEEN = re.compile(r"[;|/,]")
_FIRST = re.compile(r"[\W_]*([^\W_]+)[\W_]{2}")
_NAME = re.compile(r"[^\W_]+(?=[\W_]{2})")
#: Words of a name, where a sign between parts says where it begins.
_NAMED = 3
#: A word is a name from this many captions on; names are sent to all workers, and more of them are an error, not a cut.
NAME_CAPTIONS, MOST_NAMES = 2, 200_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DROP = bytes(b for b in range(128) if not chr(b).isalnum())
_MASK = (1 << 128) - 1
_TOP = 1 << 63


def folded(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def letters(text: str) -> str:
    """The letters and digits of a text, whatever its case, punctuation, spacing or Unicode form."""
    if text.isascii():
        return text.encode().translate(_LOWER, _DROP).decode()
    return _OTHER.sub("", folded(text))


def _pair(name: list[str], value: list[str]) -> str:
    return "".join(name) + "\x1f" + "".join(value)


def _named_parts(piece: str) -> list[str] | None:
    """The ``name, value`` parts of a piece without signs between parts; None if it isn't made of them."""
    at = [m.start() for m in _SIGN.finditer(piece)]
    cuts = [_WORD.findall(piece[a:b]) for a, b in zip([0, *(k + 1 for k in at)], [*at, len(piece)])]
    if len(cuts) == 2:
        name, value = cuts
        return [_pair(name, value)] if 0 < len(name) <= _NAMED and value else None
    # without anything between the parts the word before a sign is the name
    if len(cuts) < 2 or len(cuts[0]) != 1 or not cuts[-1] or any(len(c) < 2 for c in cuts[1:-1]):
        return None
    names = [cuts[0], *([c[-1]] for c in cuts[1:-1])]
    return [_pair(n, v) for n, v in zip(names, [*(c[:-1] for c in cuts[1:-1]), cuts[-1]])]


def _signed_parts(text: str) -> list[str] | None:
    ways = [_BETWEEN.split(text.replace("\n", " "))] if _BETWEEN.search(text) else [text.split("\n"), [text.replace("\n", " ")]]
    for pieces in ways:
        told = [_named_parts(x) for x in pieces if _WORD.search(x)]
        if all(told):
            parts = [p for t in told for p in t]
            if len(parts) > 1:
                return parts
    return None


def _gapped_parts(text: str, names: frozenset[str]) -> list[str] | None:
    at = [m for m in _NAME.finditer(text) if m[0] in names]
    if len(at) < 2 or _WORD.search(text, 0, at[0].start()):
        return None
    values = [_WORD.findall(text[a.end() : b]) for a, b in zip(at, [*(m.start() for m in at[1:]), len(text)])]
    return [_pair([m[0]], v) for m, v in zip(at, values)] if all(values) else None


def caption_parts(caption: str, names: frozenset[str] = frozenset()) -> list[str]:
    """What a caption consists of: its named parts, or its letters as one value; nothing for a letterless one."""
    first = _FIRST.match(caption)
    if first and (_SIGN.search(caption) or not caption.isascii() or first[1].lower() in names):
        text = folded(caption)
        parts = (_signed_parts(text) if _SIGN.search(text) else None) or _gapped_parts(text, names)
        if parts:
            return parts
    elif _SIGN.search(caption):
        parts = _signed_parts(folded(caption))
        if parts:
            return parts
    value = letters(caption)
    return [value] if value else []


def learned_names(motion_index: DataFrame, *, least: int = NAME_CAPTIONS) -> frozenset[str]:
    """Words that stand in front of a colon or an equals sign in captions that hold several of them."""
    name = F.regexp_extract_all(F.lower("c"), F.lit(r"(?:^|[;|/,\n])\s*([\p{L}\p{N}]+)\s*[:=]"), 1)
    told = motion_index.select(F.explode("captions").alias("c")).where("c LIKE '%:%' OR c LIKE '%=%'").select(F.array_distinct(name).alias("names")).where("size(names) > 1")
    rows = told.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names of attributes")
    return frozenset(folded(r.name) for r in rows)


def record_content(captions: list[str | None] | None, description: str | None, names: frozenset[str] = frozenset()) -> list[list[str]]:
    """Description first, then every caption that counts; empty if the record says nothing."""
    told = [p for c in captions or () if c and (p := caption_parts(c, names))]
    value = letters(description) if description else ""
    return [[value], *told] if told or value else []


def _digest(kind: bytes, value: bytes) -> int:
    return xxhash.xxh3_128_intdigest(kind + value)


def fingerprint(content: list[list[str]]) -> int:
    """Additive multiset hash of the pairs of a record."""
    total = _digest(b"description=", content[0][0].encode("utf-8", "surrogatepass"))
    for parts in content[1:]:
        if len(parts) == 1:
            one = _digest(b"caption=", parts[0].encode("utf-8", "surrogatepass"))
        else:
            # name and value stand apart in a part, so they are two fields of its hash
            inner = sum(_digest(b"part=", p.encode("utf-8", "surrogatepass")) for p in parts) & _MASK
            one = _digest(b"captions=", inner.to_bytes(16, "little"))
        total += one
    return total & _MASK


def same(a: list[list[str]], b: list[list[str]]) -> bool:
    """Equality of two contents as description and multiset of captions, each a multiset of parts."""
    if len(a) != len(b) or list(a[0]) != list(b[0]):
        return False
    form = lambda rest: Counter(frozenset(Counter(p).items()) for p in rest)
    return form(a[1:]) == form(b[1:])


_NORMAL = "record_id bigint, fp_high bigint, fp_low bigint, content array<array<string>>"


def normal_records(motion_index: DataFrame) -> DataFrame:
    """``(record_id, fp_high, fp_low, content)`` of every record that says something."""
    shared = motion_index.sparkSession.sparkContext.broadcast(learned_names(motion_index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, high, low, contents = [], [], [], []
            for record, captions, description in zip(*(batch.column(k).to_pylist() for k in range(3))):
                said = record_content(captions, description, shared.value)
                if said:
                    mark = fingerprint(said)
                    ids.append(record)
                    high.append((mark >> 64) - _TOP)
                    low.append((mark & (2 * _TOP - 1)) - _TOP)
                    contents.append(said)
            columns = [pa.array(ids, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(contents, pa.list_(pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["record_id", "fp_high", "fp_low", "content"])

    read = motion_index.where(F.col("record_id").isNotNull()).select("record_id", "captions", "description")
    return spread(read).mapInArrow(run, _NORMAL)


@F.pandas_udf(T.BooleanType())
def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same(x, y) for x, y in zip(a, b)], dtype=bool)


def copies(motion_index: DataFrame, *, hot_share: float = HOT_SHARE) -> DataFrame:
    """``(keep_id, copy_id)``, one row for every record but the first of its group.

    Only ids and fingerprints are grouped. The content of the record that is kept goes to the members of its group by a
    join, in which a group that holds more than ``hot_share`` of all records is dealt to as many salts as it holds
    shares; there are at most ``1 / hot_share`` such groups, and twice that many rows are all that is repeated.
    """
    normal = materialize(normal_records(motion_index), "p1-normal")
    mark = ["fp_high", "fp_low"]
    most = max(1.0, normal.count() * hot_share)
    grouped = normal.groupBy(*mark).agg(F.min("record_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(grouped.withColumn("salts", F.ceil(F.col("n") / most).cast("int")).drop("n"), "p1-groups")
    hot = F.broadcast(groups.where("salts > 1").select(*mark, "salts"))
    # a row delivered twice has one id: any of its contents is the kept one
    kept = normal.join(groups, (normal["record_id"] == groups["keep_id"]) & (normal["fp_high"] == groups["fp_high"]) & (normal["fp_low"] == groups["fp_low"]))
    kept = kept.select(groups["fp_high"], groups["fp_low"], "keep_id", "salts", F.col("content").alias("kept")).dropDuplicates(["fp_high", "fp_low", "keep_id"])
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    members = normal.join(hot, mark, "left").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    found = members.join(kept, [*mark, "salt"]).where("record_id <> keep_id")
    return found.where(_verified("content", "kept")).select("keep_id", F.col("record_id").alias("copy_id"))


def collapsed(motion_index: DataFrame) -> DataFrame:
    """``(record_id, n_copies)``: every record that stays, with the number of records it stands for."""
    found = materialize(copies(motion_index), "p1-copies")
    counts = found.groupBy("keep_id").agg(F.count("*").alias("more"))
    return (
        motion_index.where(F.col("record_id").isNotNull())
        .select("record_id")
        .join(found, F.col("record_id") == F.col("copy_id"), "left_anti")
        .join(counts, F.col("record_id") == F.col("keep_id"), "left")
        .select("record_id", (F.coalesce("more", F.lit(0)) + 1).alias("n_copies"))
    )
