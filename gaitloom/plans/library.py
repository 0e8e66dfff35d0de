"""Faceted browsing: filters, self-excluding counts, sorted pages, a counted tree."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facets as A
from ..operators import ranking as R


@dataclass(frozen=True)
class Browse:
    filters: Mapping[str, str | None] = field(default_factory=dict)
    include_descendants: bool = True
    sort: str = "relevance"
    offset: int = 0
    limit: int = 9
    include_facets: bool = True


class UnknownNode(ValueError):
    pass


def browse(rows: DataFrame, nodes: DataFrame, request: Browse, scored: DataFrame | None = None) -> dict[str, DataFrame | None]:
    """``page``, ``total`` and ``facets`` of a request over ``facets.library`` rows.

    With ``scored`` (object_id, score) only the retrieved pool is browsed: total and counts are the pool's.
    """
    node = request.filters.get("action_node")
    if node and nodes.where(F.col("id") == node).isEmpty():
        raise UnknownNode(node)
    base = rows.join(scored, "object_id") if scored is not None else rows
    kept = A.filtered(base, request.filters, request.include_descendants)
    return {
        "page": R.page(kept, sort=request.sort, offset=request.offset, limit=request.limit),
        "total": kept.agg(F.count("*").alias("total")),
        "facets": A.facet_counts(base, request.filters, request.include_descendants) if request.include_facets else None,
    }


def tree(nodes: list[dict], counts: Mapping[str, int], direct: Mapping[str, int]) -> list[dict]:
    """Nested nodes with their counts; legacy-only branches are left out. The catalog is a small driver-side list."""
    children: dict[str | None, list[dict]] = {}
    for n in nodes:
        children.setdefault(n["parent_id"], []).append(n)

    def grown(n: dict) -> dict:
        own = {"id": n["id"], "label": n["zh_cn"], "en": n["en"], "kind": n["kind"], "count": counts.get(n["id"], 0), "direct_count": direct.get(n["id"], 0)}
        own |= {f: n[f] for f in ("summary", "focus") if n.get(f)}
        return own | {"tags": [grown(c) for c in children.get(n["id"], []) if not c.get("legacy_only")]}

    return [grown(n) for n in children.get(None, []) if not n.get("legacy_only")]
