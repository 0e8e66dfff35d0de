"""Filling fixed-capacity containers with texts (problem 8).

Method. Token counts come from the corpus encoder. Every row gets a number of its own, and rows are dealt into
randomised groups of about ``GROUP_ITEMS`` by a hash of id and number, so that a group is a bounded random sample of
the corpus whatever the order of the input, and however many rows have one id or none; each group of each plan is packed by first-fit decreasing, the first fitting
container being found with a tournament tree over the free room of the containers. A text longer than
the capacity is cut into full containers, which need no search, and one remainder, which is packed.

Defined results: every row comes out; null and empty texts have 0 tokens and lie in the first container
of their group; plans with a null or non-positive capacity, or without a tokenizer's name, give no rows; a tokenizer
that has no file is an error; an empty table gives no rows. Repeated rows and rows without an id are separate items
in containers of their own. Extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .bpe import count_tokens

#: Items in a randomised group; a bound on the memory of a task that doesn't grow with the corpus.
GROUP_ITEMS = 20_000
#: Plans are configuration; more than this is an error, not a truncation.
MOST_PLANS = 1_000


class FirstFit:
    """Containers in order of opening, with a tournament tree of their free room."""

    def __init__(self, capacity: int, items: int):
        self.capacity, self.opened = capacity, 0
        self.leaves = 1 << max(0, (max(1, items) - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """Number of the first container with room; unopened ones count as empty and follow the opened."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        place = node - self.leaves
        tree[node] -= size
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a >= b else b
        self.opened = max(self.opened, place + 1)
        return place


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; every size must be at most the capacity."""
    bins = FirstFit(capacity, len(sizes))
    places = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        places[k] = bins.put(sizes[k])
    return places


def _plans(capacities: DataFrame) -> list[tuple[int, str, int]]:
    rows = capacities.select("plan_id", "tokenizer", "capacity").limit(MOST_PLANS + 1).collect()
    if len(rows) > MOST_PLANS:
        raise ValueError(f"more than {MOST_PLANS} packing plans")
    return [(r.plan_id, r.tokenizer, r.capacity) for r in rows if r.plan_id is not None and r.tokenizer and (r.capacity or 0) > 0]


_OUT = "plan_id int, container_id string, doc_id bigint, part_no int, first_token bigint, n_tokens bigint"


def pack(documents: DataFrame, capacities: DataFrame, *, folder: str | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``(plan_id, container_id, doc_id, part_no, first_token, n_tokens)``, one row per placed part."""
    spark = documents.sparkSession
    plans = _plans(capacities)
    if not plans:
        return spark.createDataFrame([], _OUT)
    counts = count_tokens(documents, tokenizers=sorted({t for _, t, _ in plans}), folder=folder)
    # numbered when it is written, so every reader of the table sees the same numbers
    counted = materialize(counts.withColumn("row_no", F.monotonically_increasing_id()), "p8-counts")
    groups = max(1, -(-documents.count() // group_items))
    chosen = spark.createDataFrame(plans, "plan_id int, tokenizer string, capacity bigint")
    items = (
        counted.join(F.broadcast(chosen), "tokenizer")
        .withColumn("full", F.floor(F.col("n_tokens") / F.col("capacity")).cast("int"))
        .withColumn("rest", F.col("n_tokens") % F.col("capacity"))
    )
    whole = (
        items.where("full > 0")
        .select("plan_id", "doc_id", "row_no", "capacity", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part_no"))
        .select(
            "plan_id",
            F.concat_ws("-", F.col("plan_id"), F.lit("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("row_no"), F.col("part_no")).alias("container_id"),
            "doc_id",
            "part_no",
            (F.col("part_no") * F.col("capacity")).alias("first_token"),
            F.col("capacity").alias("n_tokens"),
        )
    )
    loose = items.where("rest > 0 or full = 0").select(
        "plan_id",
        F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(groups)).alias("group_no"),
        "row_no",
        "doc_id",
        F.col("full").alias("part_no"),
        (F.col("full") * F.col("capacity")).alias("first_token"),
        F.col("rest").alias("n_tokens"),
        "capacity",
    )

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "row_no"], ascending=[False, True], kind="stable", ignore_index=True)
        bins = first_fit_decreasing(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]))
        head = f"{pdf['plan_id'].iloc[0]}-{pdf['group_no'].iloc[0]}-"
        return pdf.assign(container_id=[head + str(b) for b in bins])[["plan_id", "container_id", "doc_id", "part_no", "first_token", "n_tokens"]]

    packed = loose.groupBy("plan_id", "group_no").applyInPandas(place, _OUT)
    return packed.unionByName(whole.select(packed.columns))


def pack_report(documents: DataFrame, capacities: DataFrame, *, folder: str | None = None) -> DataFrame:
    """Per plan: containers used, the least number possible by volume, and the share of room filled."""
    used = pack(documents, capacities, folder=folder).groupBy("plan_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    return (
        used.join(F.broadcast(capacities.select("plan_id", "capacity")), "plan_id")
        .groupBy("plan_id", "capacity")
        .agg(F.count("*").alias("containers"), F.sum("parts").alias("parts"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")))
        .withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
    )
