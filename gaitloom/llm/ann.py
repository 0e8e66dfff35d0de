"""Most similar vectors for every vector (problem 4).

Method. Vectors of unit length are dealt into shards of bounded size by their nearest centroid, and a robust-pruned
directed graph is built in every shard (``graph.Graph``): greedy searches propose neighbours, relaxed distance pruning
keeps diverse edges. When a graph is finished, a beam search over it gives the neighbours of all its vectors, and of the
vectors of near shards, which are sent there as queries; what is found holds in both directions. A shard that would be too
large is split, and vectors of one part search the graphs of the others; stated query sets search the graphs of their
nearest cells. Lists from several shards are merged by vector.

Equal vectors are one node of a graph, and every one of them gets a list of its own. Centroids are fitted in two levels on
a bounded sample (``fit_rows``: 20 rows a cell, at most ``MOST_FIT``); every vector is indexed. Recall against brute force
is held at 0.9 or more by the tests, and figures are in the README.

Defined results: vectors that are null, empty, of another length than most, all zero or not finite take no part; a null
id takes no part. Of equal cosines the smaller id comes first, so of a group of identical vectors only the
``k + 1`` smallest ids can be neighbours, and hardly more of them are sent anywhere: the list of any further copy are the
``k`` smallest ids of its group. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .graph import Graph

#: Rows aimed at in a cell, most cells, and most rows of one graph.
CELL_ROWS, MOST_CELLS, SHARD_ROWS = 10_000, 20_000, 30_000
#: Rows the centroids are fitted on: at least, a cell, and at most (this times 4 bytes a dimension reaches the driver).
LEAST_FIT, FIT_A_CELL, MOST_FIT = 20_000, 20, 400_000
#: Cells a group of centroids is kept to, and groups in which a vector looks for its nearest centroids.
FLAT, GROUPS = 512, 4
#: Cells around a vector, and how much less their cosine may be than the first's, whose finished graphs it searches.
AROUND, REACH = 4, 0.2
#: Width of the beam by which all vectors search finished graphs.
BEAM = 16
#: Cells a stated query searches, and the width of its beam.
PROBES, QUERY_BEAM = 10, 96


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and the places of the rows they come from; unusable rows are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(at)).flatten().cast(pa.float32())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(at), dims).astype(np.float32)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype(np.float32), at[good]


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of a bounded sample."""
    random = np.random.default_rng(4)
    c = x[random.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c).astype(np.float32)
    return c


class Cells:
    """Centroids in groups: up to ``FLAT`` of them are one group, more are fitted group by group.

    A vector is held against the centroids of its ``GROUPS`` nearest groups only, so the work a vector grows with the
    square root of the number of cells.
    """

    def __init__(self, x: np.ndarray, cells: int):
        groups = 1 if cells <= FLAT else int(np.ceil(np.sqrt(cells)))
        self.top = fit_centroids(x, groups)
        own = np.concatenate([(x[a : a + 4096] @ self.top.T).argmax(1) for a in range(0, len(x), 4096)])
        share = np.bincount(own, minlength=len(self.top))
        parts = [fit_centroids(x[own == g], max(1, round(cells * share[g] / len(x)))) if share[g] else self.top[g : g + 1] for g in range(len(self.top))]
        self.first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        self.centroids = np.concatenate(parts)

    def __len__(self) -> int:
        return len(self.centroids)

    def nearest(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cells of every row, best first, and their cosines; -1 and -2 where there are fewer."""
        most = min(most, len(self))
        cell = np.full((len(x), most), -1, np.int64)
        value = np.full((len(x), most), -2, np.float32)
        near = x @ self.top.T
        chosen = np.argpartition(-near, min(GROUPS, near.shape[1]) - 1, axis=1)[:, :GROUPS]
        for g in np.unique(chosen):
            rows = np.flatnonzero((chosen == g).any(1))
            a, z = self.first[g], self.first[g + 1]
            every = np.concatenate([value[rows], x[rows] @ self.centroids[a:z].T], 1)
            named = np.concatenate([cell[rows], np.broadcast_to(np.arange(a, z), (len(rows), z - a))], 1)
            best = np.argpartition(-every, most - 1, axis=1)[:, :most]
            value[rows], cell[rows] = np.take_along_axis(every, best, 1), np.take_along_axis(named, best, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        return np.take_along_axis(cell, order, 1), np.take_along_axis(value, order, 1)


def _layout(vectors: DataFrame) -> tuple[int, Cells | None, np.ndarray]:
    """Dimension, cells, and the number of graphs of every cell."""
    none = 0, None, np.zeros(0, int)
    usable = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    total = usable.count()
    if not total:
        return none
    wanted = int(np.clip(-(-total // CELL_ROWS), 1, MOST_CELLS))
    fit_rows = int(np.clip(FIT_A_CELL * wanted, LEAST_FIT, MOST_FIT))
    step = max(1, -(-total // fit_rows))
    sample = usable.where(F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(step)) == 0) if step > 1 else usable
    rows = sample.select("vec_id", "embedding").limit(2 * fit_rows).toArrow().sort_by("vec_id")
    lengths = rows["embedding"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    if not len(lengths):
        return none
    dims = int(np.bincount(lengths).argmax())
    x = unit_rows(rows["embedding"], dims)[0]
    if not len(x):
        return none
    cells = Cells(x, wanted)
    share = np.bincount(np.concatenate([cells.nearest(x[a : a + 4096], 1)[0][:, 0] for a in range(0, len(x), 4096)]), minlength=len(cells)) / len(x)
    return dims, cells, np.maximum(1, np.ceil(share * total * 1.3 / SHARD_ROWS)).astype(int)


def _first_copies(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places that keep, of identical vectors, those with the smallest ids."""
    order = np.argsort(ids, kind="stable")
    kind = np.unique(x[order].view(np.dtype((np.void, x.shape[1] * 4))).ravel(), return_inverse=True)[1]
    by = np.argsort(kind, kind="stable")
    start = np.concatenate(([True], np.diff(kind[by]) != 0))
    rank = np.arange(len(by)) - np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
    return np.sort(order[by[rank < most]])


_SENT = "cell int, part int, member boolean, vec_id bigint, vector binary"
_HIT = "vec_id bigint, other bigint, cosine double"


def _packed(x: np.ndarray) -> pa.Array:
    """Rows as bytes: of half precision where that loses nothing, else of single precision."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    if (half == x).all():
        x = half
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of packed rows."""
    wide = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    x = np.empty((len(column), dims), np.float32)
    for size, kind in ((2, np.float16), (4, np.float32)):
        at = np.flatnonzero(wide == dims * size)
        if len(at):
            own = column.take(pa.array(at)) if len(at) < len(column) else column
            flat = np.frombuffer(own.buffers()[2], np.uint8)
            start = np.frombuffer(own.buffers()[1], np.int32)[own.offset]
            x[at] = flat[start : start + len(at) * dims * size].view(kind).reshape(len(at), dims)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    return (x / norm[:, None]).astype(np.float32)


def _dealt(vectors: DataFrame, dims: int, cells: Cells, parts: np.ndarray, k: int, *, probes: int = 0) -> DataFrame:
    """Every vector as a member of its shard, and as a query of the others it has to search.

    With ``probes`` only the rows that hold ``asked`` are queries, of that many cells each; else all rows are, of the
    near cells they are not in.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((cells, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, split = shared.value
        for batch in batches:
            x, at = unit_rows(batch.column(1), dims)
            if not len(x):
                continue
            ids = batch.column(0).to_numpy()[at]
            asked = batch.column(2).to_numpy(zero_copy_only=False)[at]
            keep = _first_copies(x, ids, k + 1)
            if probes:
                keep = np.union1d(keep, np.flatnonzero(asked))
            x, ids, asked, at = x[keep], ids[keep], asked[keep], at[keep]
            top, value = near.nearest(x, probes or AROUND)
            # by the vector, so that equal ones meet in one graph
            part = np.array([xxhash.xxh3_64_intdigest(v) >> 33 for v in x]) % split[top[:, 0]] if (split > 1).any() else np.zeros(len(x), int)
            sent = [(np.arange(len(x)), top[:, 0], part, np.ones(len(x), bool))]
            close = np.repeat(asked[:, None], top.shape[1], 1) if probes else value >= value[:, :1] - REACH
            q, z = np.nonzero(close & (top >= 0))
            number = split[top[q, z]]
            each = np.repeat(np.arange(len(q)), number)
            other = np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number)
            own = (z[each] == 0) & (other == part[q[each]])
            use = np.ones(len(each), bool) if probes else ~own
            sent.append((q[each][use], top[q, z][each][use], other[use], np.zeros(int(use.sum()), bool)))
            row, cell, part, member = (np.concatenate(v) for v in zip(*sent))
            raw = batch.column(1).take(pa.array(at)).flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(len(at), dims)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(member), pa.array(ids[row]), _packed(raw).take(pa.array(row))],
                names=["cell", "part", "member", "vec_id", "vector"],
            )

    return vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding", "asked").mapInArrow(run, _SENT)


def _expanded(a: np.ndarray, b: np.ndarray, s: np.ndarray, first: np.ndarray, members: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class neighbours (a, b, s) as vector neighbours; members of class i are ids[members[first[i]:first[i+1]]]."""
    na, nb = np.diff(first)[a], np.minimum(np.diff(first)[b], k + 1)
    each = np.repeat(np.arange(len(a)), na * nb)
    inner = np.arange(len(each)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
    va = ids[members[first[a[each]] + inner // nb[each]]]
    vb = ids[members[first[b[each]] + inner % nb[each]]]
    return va, vb, s[each]


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every a: highest s, then smallest b; repeated pairs count once, a itself not at all."""
    order = np.lexsort((b, -s, a))
    order = order[a[order] != b[order]]
    pair = np.stack([a[order], b[order]], 1)
    once = np.sort(np.unique(pair, axis=0, return_index=True)[1]) if len(pair) else np.zeros(0, int)
    order = order[once]
    start = np.concatenate(([True], np.diff(a[order]) != 0)) if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
    return order[rank < k]


def shard_neighbours(x: np.ndarray, ids: np.ndarray, member: np.ndarray, k: int, least: float, *, all_members: bool, query_beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours found in one shard: of all its members (by entering it and by searching it), and of its queries."""
    keep = np.flatnonzero(member)
    keep = keep[_first_copies(x[keep], ids[keep], k + 1)]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(keep):
        return none
    kind = np.unique(x[keep].view(np.dtype((np.void, x.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    place, own = kind[1], kind[2].ravel()
    members = keep[np.lexsort((ids[keep], own))]
    first = np.concatenate(([0], np.cumsum(np.bincount(own))))
    distinct = np.ascontiguousarray(x[keep][place])
    graph = Graph(distinct)
    out = []
    if all_members:
        found, score = graph.search(distinct, query_beam)
        a, z = np.nonzero((found < graph.n) & (score >= least))
        b, s = found[a, z].astype(np.int64), score[a, z]
        use = a != b
        a, b, s = a[use], b[use], s[use]
        self_ = np.flatnonzero(np.diff(first) > 1)
        a, b, s = np.concatenate([a, b, self_]), np.concatenate([b, a, self_]), np.concatenate([s, s, np.ones(len(self_))])
        out.append(_expanded(a, b, s, first, members, ids, k))
    ask = np.flatnonzero(~member)
    if len(ask):
        found, score = graph.search(x[ask], query_beam)
        q, z = np.nonzero((found < graph.n) & (score >= least))
        b, s = found[q, z].astype(np.int64), score[q, z]
        number = np.minimum(np.diff(first)[b], k + 1)
        each = np.repeat(np.arange(len(b)), number)
        inner = np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number)
        asks, answers = ids[ask[q[each]]], ids[members[first[b[each]] + inner]]
        out.append((asks, answers, s[each]))
        if all_members:
            out.append((answers, asks, s[each]))
    if not out:
        return none
    a, b, s = (np.concatenate(z) for z in zip(*out))
    best = _best(a, b, s, k)
    return a[best], b[best], s[best].astype(np.float64)


def _searched(dealt: DataFrame, parts: np.ndarray, dims: int, k: int, least: float, *, all_members: bool, query_beam: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        vectors = group["vector"].combine_chunks()
        x = _unpacked(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors, dims)
        a, b, s = shard_neighbours(x, group["vec_id"].to_numpy(), group["member"].to_numpy(), k, least, all_members=all_members, query_beam=query_beam)
        return pa.table({"vec_id": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "cosine": pa.array(s, pa.float64())})

    # twice as many partitions as graphs, whatever the session's number: a task holds one graph or a few, never more as cells grow in number
    spread = dealt.repartition(2 * int(parts.sum()), "cell", "part")
    found = spread.groupBy("cell", "part").applyInArrow(run, _HIT)
    best = found.groupBy("vec_id", "other").agg(F.max("cosine").alias("cosine"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= k)


def _nearest(vectors: DataFrame, dims: int, cells: Cells, parts: np.ndarray, k: int, least: float) -> DataFrame:
    """The k nearest of every vector but the further copies of ``_further_copies``."""
    dealt = _dealt(vectors.select("vec_id", "embedding", F.lit(False).alias("asked")), dims, cells, parts, k)
    return _searched(dealt, parts, dims, k, least, all_members=True, query_beam=BEAM)


def _further_copies(vectors: DataFrame, dims: int, k: int) -> DataFrame:
    """``(vec_id, others)``: identical vectors beyond the ``k + 1`` smallest ids, with the ``k`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = unit_rows(batch.column(1), dims)
            keys = pa.array([xxhash.xxh3_128_digest(row) for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), keys], names=["vec_id", "key"])

    keyed = materialize(vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, key binary"), "p4-keys")
    first = keyed.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    # written, so that the join below can split a key that a third of all vectors has
    groups = materialize(first.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).where(F.size("ids") > k), "p4-crowds")
    return keyed.join(groups, "key").where(F.col("vec_id") > F.element_at("ids", -1)).select("vec_id", F.slice("ids", 1, k).alias("others"))


def nearest_of_all(vectors: DataFrame, *, k: int = 5, least: float = -1.0) -> DataFrame:
    """``(vec_id, other, cosine, rank)``: the k nearest of every vector whose cosine is at least ``least``."""
    dims, cells, parts = _layout(vectors)
    if cells is None:
        return vectors.sparkSession.createDataFrame([], _HIT + ", rank int")
    further = materialize(_further_copies(vectors, dims, k), "p4-further")
    near = _nearest(vectors, dims, cells, parts, k, least).join(further.select("vec_id"), "vec_id", "left_anti")
    told = further.select("vec_id", F.posexplode("others").alias("place", "other"))
    return near.unionByName(told.select("vec_id", "other", F.lit(1.0).alias("cosine"), (F.col("place") + 1).alias("rank")))


def nearest_of_queries(vectors: DataFrame, asked, *, k: int = 5, probes: int = PROBES, beam: int = QUERY_BEAM) -> DataFrame:
    """The same for the rows that hold ``asked`` (a boolean column), against all rows, by beam search."""
    dims, cells, parts = _layout(vectors)
    if cells is None:
        return vectors.sparkSession.createDataFrame([], _HIT + ", rank int")
    dealt = _dealt(vectors.select("vec_id", "embedding", F.coalesce(asked, F.lit(False)).alias("asked")), dims, cells, parts, k, probes=probes)
    return _searched(dealt, parts, dims, k, -1.0, all_members=False, query_beam=beam)


def mutual_pairs(vectors: DataFrame, *, k: int = 5, least: float = 0.9) -> DataFrame:
    """``(vec_a, vec_b)``: each among the k nearest of the other, with at least the given cosine."""
    dims, cells, parts = _layout(vectors)
    if cells is None:
        return vectors.sparkSession.createDataFrame([], "vec_a bigint, vec_b bigint")
    # further copies are among the nearest of no vector
    near = _nearest(vectors, dims, cells, parts, k, least)
    return near.groupBy(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).agg(F.count("*").alias("n")).where("n = 2").select("vec_a", "vec_b")
