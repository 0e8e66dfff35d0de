"""Models over tables: encoders of text columns and scorers of text pairs, loaded once a worker, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts -> matrix of vectors; pairs -> scores. What is sent to the workers is a function that loads one of them.
Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[tuple[str, str]]], Sequence[float]]


def last_token_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """State of the last token that is no padding, for batches padded on either side (texts x tokens x width)."""
    last = mask.shape[1] - 1 - np.argmax(mask[:, ::-1] > 0, axis=1)
    return hidden[np.arange(len(hidden)), last]


def l2_normalized(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; a zero row stays zero."""
    x = np.asarray(x, np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, np.float32(1e-12))


def _encoded(model: Encoder, texts: list[str | None], batch: int) -> list[list[float] | None]:
    """Unit vectors of texts; equal texts are encoded once, null and blank ones are null."""
    told = [" ".join(t.split()) if t else "" for t in texts]
    distinct = sorted({t for t in told if t}, key=lambda t: (len(t), t))  # of like length, so little is padded
    made: dict[str, list[float]] = {}
    for a in range(0, len(distinct), batch):
        some = distinct[a : a + batch]
        made.update(zip(some, l2_normalized(model(some)).tolist()))
    return [made.get(t) for t in told]


def encode_texts(rows: DataFrame, columns: Sequence[str], load: Callable[[], Encoder], *, batch: int = 256) -> DataFrame:
    """``rows`` with ``<column>_embedding`` for every text column; the model is loaded once for all batches of a partition."""
    names, wide = list(rows.columns), list(columns)
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"`{c}_embedding` array<float>" for c in wide])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for part in batches:
            model = model or load()
            made = [pa.array(_encoded(model, part.column(names.index(c)).to_pylist(), batch), pa.list_(pa.float32())) for c in wide]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*names, *(f"{c}_embedding" for c in wide)])

    return rows.mapInArrow(run, kinds)


def score_pairs(pairs: DataFrame, load: Callable[[], Scorer], *, query: str = "query", document: str = "document", score: str = "pair_score", batch: int = 64) -> DataFrame:
    """``pairs`` with the score of every (query, document); texts that differ in case or blanks only are one pair.

    Pairs are made distinct before the model sees them and joined back, so nothing is scored twice, whatever the skew. Pairs
    with a null side have no score.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    keyed = pairs.withColumn("_q", plain(query)).withColumn("_d", plain(document))
    distinct = keyed.where("_q IS NOT NULL AND _d IS NOT NULL").select("_q", "_d").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for part in batches:
            model = model or load()
            both = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            made = [float(s) for a in range(0, len(both), batch) for s in model(both[a : a + batch])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.float64())], names=["_q", "_d", score])

    scored = distinct.mapInArrow(run, f"_q string, _d string, {score} double")
    return keyed.join(scored, ["_q", "_d"], "left").drop("_q", "_d")
