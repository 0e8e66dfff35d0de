"""Connected components of a pair table by alternating large and small stars.

Every round shuffles the edges twice and nothing is collected; the number of rounds grows with the logarithm of the
longest chain. Between rounds the edges are written to the shared folder, which cuts the lineage and outlives executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize

#: A chain of 2**ROUNDS links; reaching it is an error, not a cut.
ROUNDS = 60


def components(pairs: DataFrame, a: str = "record_a", b: str = "record_b") -> DataFrame:
    """``(id, root)`` for every id in a pair; root is the smallest id of its component."""
    edges = materialize(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "stars")
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every neighbour above a vertex moves to the least neighbour of that vertex
        # (written, so that the join can split the edges of a hub)
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a vertex and its lower neighbours move to the least of these
        large = materialize(large, "stars-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "stars-low")
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        fresh = materialize(small, "stars")
        same = fresh.exceptAll(edges).isEmpty() and fresh.count() == edges.count()
        edges = fresh
        if same:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components not settled after {ROUNDS} rounds")
