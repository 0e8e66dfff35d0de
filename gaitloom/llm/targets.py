"""A sample whose category shares match given targets (problem 2).

Method. One distributed aggregation gives the category moments (rows available for every pair of dataset and category).
From these few numbers the inclusion probabilities are calibrated by Newton iterations on the dual of the
exponential-tilting problem. Where targets are given for the margins (datasets and categories each), the features are
the indicators of both, and probabilities are their tilted product. Where they are given for every pair, the shares are
tilted by one parameter a plan, so that the rows of all pairs add up to the sample. Pairs that would leave their bounds
(all available rows, floors) are fixed there, and the dual of the rest is solved again. The sample is
drawn by the pivotal method in three levels: blocks of a category, the block remainders of a category, the category
remainders of a plan. A block is bounded, and leaves at most one undecided row, so no task sees a whole category.
Targets that can't be met are those that a sample leaves short whose floors are the requests of all targets.

Defined results: rows with a null object_id, dataset or category are not candidates; an object counts once
per dataset; a null share or minimum counts as 0; targets with a null dataset or category match nothing and
are reported as unmet if they ask for any row; targets without a plan_id are a plan of their own; of a target that
stands twice the shares are added and the larger minimum holds; empty tables give an empty sample and unmet targets.
The draw depends on the seed and the object ids only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .assets import dataset_key, in_force

#: Rows of a block in the first level of the pivotal method.
BLOCK_ROWS = 50_000
#: Target rows are configuration; more than this is an error, not a truncation.
MOST_TARGETS = 100_000
_EPS = 1e-9
#: What the pivotal method takes for rounding errors of 0 and 1; a row's probability in a large category is far below _EPS.
_SURE = 1e-13


def candidates(motion_index: DataFrame, motion_entry: DataFrame) -> DataFrame:
    """Distinct ``(object_id, dataset, action_category)`` of assets with a category in force."""
    assets = motion_index.where(F.col("object_id").isNotNull()).select("object_id", dataset_key().alias("dataset")).where("dataset is not null").distinct()
    return assets.join(in_force(motion_entry).where("action_category is not null"), "object_id").select("object_id", "dataset", "action_category")


def target_report(available: DataFrame, targets: DataFrame) -> DataFrame:
    """Every target row with the rows it asks for, those available, and whether it can be met."""
    moments = available.groupBy("dataset", "action_category").agg(F.count("*").alias("available"))
    wanted = targets.select("plan_id", "sample_size", "dataset", "action_category", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"))
    return (
        wanted.join(moments, ["dataset", "action_category"], "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("requested", F.greatest(F.col("min_rows").cast("bigint"), F.round(F.col("target_share") * F.coalesce("sample_size", F.lit(0))).cast("bigint")))
        .withColumn("met", F.col("available") >= F.col("requested"))
        .select("plan_id", "sample_size", "dataset", "action_category", "target_share", "min_rows", "requested", "available", "met")
    )


def bounded_totals(share: np.ndarray, least: np.ndarray, most: np.ndarray, size: float) -> np.ndarray:
    """Totals proportional to the shares, within floors and ceilings, that add up to the size if they can."""
    floor = np.minimum(least, most)
    size = float(np.clip(size, floor.sum(), most.sum()))
    total, free = np.zeros(len(share)), np.ones(len(share), bool)
    total[:] = floor
    for _ in range(2 * len(share) + 2):
        weight = np.where(free, share, 0.0)
        room = size - total[~free].sum()
        trial = np.where(free, weight * (room / weight.sum() if weight.sum() > 0 else 0.0), total)
        low, high = free & (trial < floor - _EPS), free & (trial > most + _EPS)
        if not (low | high).any():
            return np.clip(trial, floor, most)
        # fix the side that is violated more, as in a water-filling search
        under, over = (floor - trial)[low].sum(), (trial - most)[high].sum()
        if under >= over:
            total[low], free = floor[low], free & ~low
        else:
            total[high], free = most[high], free & ~high
    return np.clip(total, floor, most)


def _tilted(moments: np.ndarray, features: np.ndarray, wanted: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Tilting factor ``exp(x.lambda)`` of each cell by Newton's method on the exponential-tilting dual.

    The dual is ``sum_c N_c exp(x_c.lambda) - lambda.T``; its gradient is the difference between tilted
    and wanted moments, its Hessian the tilted second moments, both functions of the category moments alone.
    Features that want nothing take their cells out.
    """
    out = np.zeros(len(moments))
    dead = features[:, wanted <= _EPS].any(1)
    x, n, t = features[~dead][:, wanted > _EPS], moments[~dead].astype(float), wanted[wanted > _EPS]
    if not len(n) or not len(t):
        return out
    lam = np.zeros(x.shape[1])
    dual = lambda v: float((n * np.exp(np.clip(x @ v, -60, 30))).sum() - v @ t)
    for _ in range(rounds):
        mass = n * np.exp(np.clip(x @ lam, -60, 30))
        slope = x.T @ mass - t
        step = np.linalg.lstsq(x.T @ (x * mass[:, None]), slope, rcond=None)[0]
        if np.abs(slope).max() < 1e-9 * max(1.0, t.max()):
            lam = lam - step  # squares what is left of the error, so that totals add up to whole rows
            break
        # near the end the gain of a step is less than the rounding error of the dual
        scale, now = 1.0, dual(lam) + 1e-12 * float(mass.sum() + abs(lam @ t) + 1)
        while scale > 1e-8 and dual(lam - scale * step) > now:
            scale /= 2
        lam = lam - scale * step
    out[~dead] = np.exp(np.clip(x @ lam, -60, 30))
    return out


def tilt(moments: np.ndarray, features: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Inclusion probability of each category so that the feature sums are those of ``totals``."""
    live = (moments > 0) & (totals > 0)
    p = np.zeros(len(moments))
    if live.any():
        p[live] = np.minimum(1.0, _tilted(moments[live], features[live], features[live].T @ totals[live]))
    return p


def pivotal(p: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Sequential pivotal method: 0/1 decisions with the given probabilities; one entry may stay undecided."""
    p = p.copy()
    draws = random.random(len(p))
    held = -1
    for k in range(len(p)):
        if p[k] <= _SURE or p[k] >= 1 - _SURE:
            p[k] = round(p[k])
            continue
        if held < 0:
            held = k
            continue
        a, b = p[held], p[k]
        if a + b < 1:
            winner, loser = (held, k) if draws[k] < a / (a + b) else (k, held)
            p[winner], p[loser] = a + b, 0.0
        else:
            winner, loser = (held, k) if draws[k] < (1 - b) / (2 - a - b) else (k, held)
            p[winner], p[loser] = 1.0, a + b - 1
            winner = loser
        held = winner if _SURE < p[winner] < 1 - _SURE else -1
        if held < 0:
            p[winner] = round(p[winner])
    return p


def _told(report: DataFrame) -> list[Row]:
    rows = report.limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target rows")
    return rows


def _probabilities(rows: list[Row], floors: str) -> list[tuple[int | None, str, str, float]]:
    """Inclusion probability of every pair of a plan; ``floors`` names the column of the rows a pair must have."""
    plans: dict[int | None, dict[tuple[str, str], list]] = {}
    size: dict[int | None, int] = {}
    for r in rows:
        size[r.plan_id] = max(size.get(r.plan_id, 0), r.sample_size or 0)
        if r.dataset is not None and r.action_category is not None:
            own = plans.setdefault(r.plan_id, {}).setdefault((r.dataset, r.action_category), [0.0, 0, r.available])
            own[0], own[1] = own[0] + max(r.target_share, 0.0), max(own[1], r[floors])
    out = []
    for plan in sorted(plans, key=lambda p: (p is not None, p or 0)):
        cells = sorted(plans[plan])
        share, least, n = np.array([plans[plan][c] for c in cells], float).T
        total = calibrated_totals(share, least, n, size[plan])
        out += [(plan, d, c, float(min(1.0, t / k))) for (d, c), t, k in zip(cells, total, n) if t > 0]
    return out


def calibrated_totals(share: np.ndarray, least: np.ndarray, most: np.ndarray, size: float) -> np.ndarray:
    """Totals that tilt the shares by one factor, within floors and ceilings, to add up to the size if they can."""
    floor = np.minimum(least, most)
    size = float(np.clip(size, floor.sum(), np.where(share > 0, most, floor).sum()))
    return bounded_tilt(most, np.ones((len(share), 1)), np.array([size]), least, share * size)


def bounded_tilt(moments: np.ndarray, features: np.ndarray, wanted: np.ndarray, least: np.ndarray | None = None, mass: np.ndarray | None = None) -> np.ndarray:
    """Totals of cells whose feature sums are ``wanted``, as near to it as floors and available rows allow.

    Cells that leave their bounds are fixed at them, and the dual of the remaining cells is solved again. ``mass`` is what
    is tilted, by default all available rows.
    """
    mass = moments if mass is None else mass
    floor = np.zeros(len(moments)) if least is None else np.minimum(least, moments)
    total, free = floor.copy(), moments > 0
    for _ in range(len(moments) + 1):
        if not free.any():
            break
        rest = np.maximum(wanted - features[~free].T @ total[~free], 0.0)
        trial = mass[free] * _tilted(mass[free], features[free], rest)
        at = np.flatnonzero(free)
        low, high = trial < floor[at] - _EPS, trial > moments[at] + _EPS
        total[at] = np.clip(trial, floor[at], moments[at])
        if not (low | high).any():
            break
        # the side that is violated more is fixed first
        side = low if (floor[at] - trial)[low].sum() >= (trial - moments[at])[high].sum() else high
        free[at[side]] = False
    return total


def margin_features(cells: list[tuple[str, str]], margins: dict[tuple[str, str], float]) -> tuple[np.ndarray, np.ndarray]:
    """Indicators of the datasets and categories of the cells, and the total each asks for."""
    named = sorted(margins)
    features = np.array([[(kind == "dataset" and value == d) or (kind == "action_category" and value == c) for kind, value in named] for d, c in cells], float)
    return features.reshape(len(cells), len(named)), np.array([margins[n] for n in named], float)


_ROW = "plan_id int, dataset string, action_category string, object_id string, p double, block bigint"


def calibrated_sample(available: DataFrame, targets: DataFrame, *, seed: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(plan_id, dataset, action_category, object_id)`` of the drawn rows."""
    available = materialize(available, "p2-candidates")
    return _draw(available, _probabilities(_told(target_report(available, targets)), "min_rows"), seed, block_rows)


def margin_sample(available: DataFrame, targets: DataFrame, *, seed: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same where only the shares of datasets and of categories are to match, not those of their pairs.

    The shares of a plan's rows are added up by dataset and by category; every available pair of a dataset and a category
    of the plan takes part.
    """
    available = materialize(available, "p2-candidates")
    moments = available.groupBy("dataset", "action_category").agg(F.count("*").alias("n")).limit(MOST_TARGETS + 1).collect()
    rows = targets.select("plan_id", "sample_size", "dataset", "action_category", F.coalesce("target_share", F.lit(0.0)).alias("share")).limit(MOST_TARGETS + 1).collect()
    if max(len(moments), len(rows)) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target rows or pairs")
    chances = []
    for plan in sorted({r.plan_id for r in rows if r.plan_id is not None}):
        margins: dict[tuple[str, str], float] = {}
        own = [r for r in rows if r.plan_id == plan]
        size = max([r.sample_size or 0 for r in own], default=0)
        for r in own:
            for kind in ("dataset", "action_category"):
                if r[kind]:
                    margins[kind, r[kind]] = margins.get((kind, r[kind]), 0.0) + r.share * size
        cells = sorted((m.dataset, m.action_category, m.n) for m in moments if ("dataset", m.dataset) in margins and ("action_category", m.action_category) in margins)
        if cells:
            n = np.array([c[2] for c in cells], float)
            features, wanted = margin_features([c[:2] for c in cells], margins)
            chances += [(plan, d, c, float(t / k)) for (d, c, k), t in zip(cells, bounded_tilt(n, features, wanted)) if t > 0]
    return _draw(available, chances, seed, block_rows)


def _draw(available: DataFrame, probabilities: list[tuple[int, str, str, float]], seed: int, block_rows: int) -> DataFrame:
    """Pivotal sample of written candidates with the given probability for every pair of a plan."""
    chances = available.sparkSession.createDataFrame(probabilities, "plan_id int, dataset string, action_category string, p double")
    sizes = available.groupBy("dataset", "action_category").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    cells = chances.join(sizes, ["dataset", "action_category"])
    units = (
        available.join(F.broadcast(cells), ["dataset", "action_category"])
        .withColumn("block", F.pmod(F.xxhash64("object_id", F.lit(seed)), F.greatest(F.col("blocks"), F.lit(1))))
        .select("plan_id", "dataset", "action_category", "object_id", "p", "block")
    )

    def draw(level: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            order = pd.util.hash_array(pdf["object_id"].to_numpy(object)) ^ np.uint64(seed)
            pdf = pdf.assign(h=order).sort_values(["h", "dataset", "action_category", "object_id"], ignore_index=True)
            mark = pd.util.hash_array(np.array(["\x1f".join(map(str, key))], object))[0]
            p = pivotal(pdf["p"].to_numpy(float), np.random.default_rng([seed, level, int(mark)]))
            if level == 2:  # the whole rows of a category stay whole, whatever the rounding errors of its blocks
                p = np.where(np.abs(p - np.rint(p)) < 1e-6, np.rint(p), p)
            return pdf.assign(p=p)[p > _SURE][["plan_id", "dataset", "action_category", "object_id", "p", "block"]]

        return run

    cell = ["plan_id", "dataset", "action_category"]
    first = materialize(units.groupBy(*cell, "block").applyInPandas(draw(1), _ROW), "p2-blocks")
    second = materialize(first.where(F.col("p") < 1).groupBy(*cell).applyInPandas(draw(2), _ROW), "p2-cells")
    third = second.where(F.col("p") < 1).groupBy("plan_id").applyInPandas(draw(3), _ROW)
    drawn = first.where(F.col("p") >= 1).unionByName(second.where(F.col("p") >= 1)).unionByName(third.where(F.col("p") >= 1 - 1e-6))
    return drawn.select(*cell, "object_id")


def sample_report(available: DataFrame, targets: DataFrame, *, seed: int = 2, block_rows: int = BLOCK_ROWS, floors: str = "min_rows") -> DataFrame:
    """The target report with the rows drawn, their share in the plan, and the gap to the request.

    ``floors``: "min_rows" for the sample of ``calibrated_sample``, "requested" for one that has every requested row there is.
    """
    available = materialize(available, "p2-candidates")
    report = target_report(available, targets)
    told = _told(report)
    drawn = materialize(_draw(available, _probabilities(told, floors), seed, block_rows), "p2-drawn")
    counts = drawn.groupBy(F.col("plan_id").alias("p"), F.col("dataset").alias("d"), F.col("action_category").alias("c")).agg(F.count("*").alias("sampled"))
    totals = drawn.groupBy(F.col("plan_id").alias("q")).agg(F.count("*").alias("plan_rows"))
    return (
        available.sparkSession.createDataFrame(told, report.schema)
        .join(counts, F.col("plan_id").eqNullSafe(F.col("p")) & (F.col("dataset") == F.col("d")) & (F.col("action_category") == F.col("c")), "left")
        .join(totals, F.col("plan_id").eqNullSafe(F.col("q")), "left")
        .withColumn("sampled", F.coalesce("sampled", F.lit(0)))
        .withColumn("sampled_share", F.round(F.col("sampled") / F.col("plan_rows"), 6))
        .withColumn("gap", F.greatest(F.lit(0), F.col("requested") - F.col("sampled")))
        .drop("plan_rows", "p", "d", "c", "q")
    )


def unmet_targets(available: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Target rows that can't be met: a sample with all requested rows there are leaves them short."""
    return sample_report(available, targets, floors="requested", **options).where("sampled < requested")
