"""Library filters and self-excluding facet counts in one scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import AXES
from .hierarchy import closure, visible


def library(entry: DataFrame, assigned: DataFrame, nodes: DataFrame, version: str | None = None) -> DataFrame:
    """``(object_id, dataset, motion_id, frame_count, <axes>, direct, subtree)``, one row per entry.

    Assignments of another version are ignored if one is named. ``participants`` follows the dataset. ``direct`` are
    the action nodes, ``subtree`` these and all their ancestors; the ancestor map of the bounded catalog is a scalar
    subquery, so no row is moved for it. Entries without an assignment have null axes and no nodes.
    """
    held = assigned.select("object_id", F.col("classification").alias("c"))
    if version is not None:
        held = held.where(F.col("c.taxonomy_version") == version)
    return entry.sparkSession.sql(
        """WITH up AS (SELECT node_id, collect_set(ancestor_id) AS ancestors FROM {closed} GROUP BY node_id),
           row AS (
             SELECT e.object_id, e.dataset, e.motion_id, e.frame_count,
                    CASE WHEN e.dataset IN ('interhuman', 'interx') THEN 'pair' WHEN e.dataset IN ('motionxpp', 'motionlab') THEN 'single' ELSE 'group_or_unknown' END AS participants,
                    c.taxonomy['space'] AS space, c.taxonomy['action_category'] AS action_category, c.taxonomy['action_tag'] AS action_tag,
                    c.taxonomy['activity_domain'] AS activity_domain,
                    coalesce(array_distinct(transform(c.action_nodes, n -> n.id)), array()) AS direct
             FROM {entry} e LEFT JOIN {held} h ON e.object_id = h.object_id)
           SELECT * EXCEPT (kin), array_distinct(flatten(transform(direct, n -> coalesce(kin[n], array(n))))) AS subtree
           FROM (SELECT *, (SELECT map_from_entries(collect_list(struct(node_id, ancestors))) FROM up) AS kin FROM row)""",
        closed=closure(nodes),
        entry=entry.select("object_id", "dataset", "motion_id", "frame_count"),
        held=held,
    )


def predicates(filters: Mapping[str, str | None], include_descendants: bool = True) -> dict[str, str]:
    """SQL text of every active filter by facet."""
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    out = {}
    for name, value in filters.items():
        if not value:
            continue
        if name == "dataset":
            out[name] = f"dataset = {quoted(value.strip().lower())}"
        elif name == "action_node":
            out[name] = f"array_contains({'subtree' if include_descendants else 'direct'}, {quoted(value)})"
        elif name in AXES:
            out[name] = f"coalesce({name} = {quoted(value)}, false)"
        else:
            raise ValueError(f"unknown filter {name}")
    return out


def filtered(rows: DataFrame, filters: Mapping[str, str | None], include_descendants: bool = True) -> DataFrame:
    for condition in predicates(filters, include_descendants).values():
        rows = rows.where(condition)
    return rows


def facet_counts(rows: DataFrame, filters: Mapping[str, str | None], include_descendants: bool = True) -> DataFrame:
    """``(facet, value, n)``: each facet counted under all filters but its own; every known value is listed.

    One scan: predicates become columns, every row gives its (facet, value, counts?) triples, and one map-side
    combined aggregation counts them.
    """
    where = predicates(filters, include_descendants)
    scope = lambda own: " AND ".join([c for f, c in where.items() if f != own] or ["true"])
    single = ", ".join(f"struct('{f}' AS facet, {f} AS value, ({scope(f)}) AS ok)" for f in ("dataset", *AXES))
    node = f"({scope('action_node')})"
    triples = f"concat(array({single}), transform(subtree, n -> struct('action_node' AS facet, n AS value, {node} AS ok)), transform(direct, n -> struct('action_node_direct' AS facet, n AS value, {node} AS ok)))"
    return rows.select(F.expr(f"inline({triples})")).where("value IS NOT NULL").groupBy("facet", "value").agg(F.count_if("ok").alias("n"))


def sparse(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts above zero, node facets over visible nodes only."""
    seen = visible(nodes).select(F.col("id").alias("value"))
    kept = counts.where("n > 0")
    plain = kept.where("facet NOT LIKE 'action\\_node%'")
    return plain.unionByName(kept.where("facet LIKE 'action\\_node%'").join(seen, "value", "left_semi"))
