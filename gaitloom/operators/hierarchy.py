"""The node forest: closure, paths, lint, counts, text filter, stable ids, legacy axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CONFLICT_TAGS, DOMAIN_OF_CATEGORY, LEGACY_BY_PREFIX
from ..plans.runtime import bounded

#: Nodes of a catalog: a bounded table that may be broadcast; more of them are an error, not a cut.
MOST_CATALOG = 100_000


def catalog_part(rows: DataFrame) -> DataFrame:
    """A table derived from the catalog, for a broadcast, after its size was checked."""
    return bounded(rows, 50 * MOST_CATALOG)


def closure(nodes: DataFrame) -> DataFrame:
    """``(node_id, ancestor_id, distance)``, every node being its own ancestor at distance 0.

    The catalog is a bounded table; the self-join is a recursive SQL query, so it stays one plan. A cycle never ends and
    is an error at the session's limit of recursion (``spark.sql.cteRecursionLevelLimit``, 100 levels).
    """
    return nodes.sparkSession.sql(
        """WITH RECURSIVE c(node_id, ancestor_id, distance) AS (
              SELECT id, id, 0 FROM {n}
              UNION ALL
              SELECT c.node_id, n.parent_id, c.distance + 1 FROM c JOIN {n} n ON n.id = c.ancestor_id
              WHERE n.parent_id IS NOT NULL)
            SELECT * FROM c""",
        n=nodes.select("id", "parent_id"),
    )


def descendants(closed: DataFrame, node_id: str) -> DataFrame:
    return closed.where(F.col("ancestor_id") == node_id).select("node_id")


def roots(closed: DataFrame) -> DataFrame:
    return closed.groupBy("node_id").agg(F.max_by("ancestor_id", "distance").alias("root_id"), (F.max("distance") + 1).alias("depth"))


def paths(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, path)``: labels from the root down."""
    named = closed.join(nodes.select(F.col("id").alias("ancestor_id"), F.col("zh_cn").alias("label")), "ancestor_id")
    return named.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "label"))), lambda x: x["label"]).alias("path"))


def lint(nodes: DataFrame, closed: DataFrame, deepest: int = 3) -> DataFrame:
    """``(id, problem)``: duplicate ids, missing parents, missing sources, nodes that lie too deep."""
    ids = nodes.select(F.col("id").alias("known")).distinct()
    twice = nodes.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("problem"))
    orphan = nodes.where("parent_id IS NOT NULL").join(ids, F.col("parent_id") == F.col("known"), "left_anti").select("id", F.lit("missing parent").alias("problem"))
    bare = nodes.where(F.coalesce(F.size("source_refs"), F.lit(0)) <= 0).select("id", F.lit("missing sources").alias("problem"))
    deep = roots(closed).where(F.col("depth") > deepest).join(nodes.where("NOT coalesce(allow_depth, false)"), F.col("node_id") == F.col("id"), "left_semi").select(F.col("node_id").alias("id"), F.lit("too deep").alias("problem"))
    return twice.unionByName(orphan).unionByName(bare).unionByName(deep)


def visible(nodes: DataFrame, leaves_only: bool = False) -> DataFrame:
    out = nodes.where("coalesce(asset_taxonomy, false) AND NOT coalesce(legacy_only, false)")
    return out.where("kind = 'action'") if leaves_only else out


def subtree_counts(closed: DataFrame, tagged: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, n, direct)``: objects tagged below or at a node, and at the node itself; zeros are listed.

    ``tagged`` is ``(object_id, node_id)``. An object counts once per ancestor.
    """
    below = tagged.join(catalog_part(closed), "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count_distinct("object_id").alias("n"))
    direct = tagged.groupBy("node_id").agg(F.count_distinct("object_id").alias("direct"))
    return nodes.select(F.col("id").alias("node_id")).join(below, "node_id", "left").join(direct, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("direct", F.lit(0)).alias("direct"))


def text_filter(nodes: DataFrame, closed: DataFrame, query: str) -> DataFrame:
    """Nodes whose label or English name holds the text, with all their ancestors."""
    q = query.strip().lower()
    hit = nodes.where(F.lower(F.coalesce("zh_cn", F.lit(""))).contains(q) | F.lower(F.coalesce("en", F.lit(""))).contains(q)).select(F.col("id").alias("node_id"))
    return closed.join(hit, "node_id", "left_semi").select(F.col("ancestor_id").alias("node_id")).distinct()


def stable_id(prefix: str, *path: Column) -> Column:
    """Id of a catalog node from its path of names."""
    return F.concat(F.lit(f"asset_{prefix}_"), F.substring(F.sha1(F.concat_ws("\x1f", *path).cast("binary")), 1, 12))


def flatten_catalog(source: DataFrame) -> DataFrame:
    """Flat nodes of a nested ``(major, summary, groups[name, focus, tags])`` table."""
    groups = source.select("major", F.explode("groups").alias("g"))
    tags = groups.select("major", F.col("g.name").alias("name"), F.explode("g.tags").alias("tag"))
    node = lambda id_, parent, kind, label, priority: (id_.alias("id"), parent.cast("string").alias("parent_id"), F.lit(kind).alias("kind"), label.alias("zh_cn"), F.lit(priority).alias("priority"))
    m, g = F.col("major"), F.col("g.name")
    return (
        source.select(*node(stable_id("major", m), F.lit(None), "domain", m, 20))
        .unionByName(groups.select(*node(stable_id("group", m, g), stable_id("major", m), "category", g, 30)))
        .unionByName(tags.select(*node(stable_id("tag", m, F.col("name"), F.col("tag")), stable_id("group", m, F.col("name")), "action", F.col("tag"), 40)))
    )


def legacy_axes(nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """``(node_id, category, tag, domain)`` by id prefix, else by the fields of the root."""
    root = roots(closed).join(nodes.select(F.col("id").alias("root_id"), "legacy_category", "legacy_tag"), "root_id")
    pick = F.when(F.lit(False), F.struct(F.lit("").alias("c"), F.lit("").alias("t")))
    for prefix, (category, tag) in LEGACY_BY_PREFIX.items():
        pick = pick.when(F.startswith("node_id", F.lit(prefix)), F.struct(F.lit(category).alias("c"), F.lit(tag).alias("t")))
    pick = pick.otherwise(F.struct(F.coalesce("legacy_category", F.lit("special_actions")).alias("c"), F.coalesce("legacy_tag", F.lit("other")).alias("t")))
    return root.select("node_id", pick.alias("p")).select("node_id", F.col("p.c").alias("category"), F.col("p.t").alias("tag"), domain_of(F.col("p.c"), F.col("p.t")).alias("domain"))


def domain_of(category: Column, tag: Column) -> Column:
    out = F.when(tag.isin(*CONFLICT_TAGS), "conflict").when(tag == "medical_care", "assist_care").when(tag.isin("basic_locomotion", "transportation_travel"), "commute_locomotion")
    for name, domain in DOMAIN_OF_CATEGORY.items():
        out = out.when(category == name, domain)
    return out.otherwise("other")


def alias_transfer(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(id, aliases_en)``: English aliases of legacy nodes joined to those of the leaf their label names.

    ``mapping`` is ``(legacy_id, target_label)``; of several nodes with one label the last id holds.
    """
    target = nodes.groupBy(F.col("zh_cn").alias("target_label")).agg(F.max("id").alias("id"))
    given = mapping.join(nodes.select(F.col("id").alias("legacy_id"), F.col("aliases_en").alias("more")), "legacy_id").join(target, "target_label")
    more = given.groupBy("id").agg(F.flatten(F.collect_list(F.coalesce("more", F.array().cast("array<string>")))).alias("more"))
    return more.join(nodes.select("id", "aliases_en"), "id").select("id", F.sort_array(F.array_union(F.coalesce("aliases_en", F.array().cast("array<string>")), F.array_distinct("more"))).alias("aliases_en"))
