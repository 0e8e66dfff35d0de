"""Rule classification by phrases, prototype classification by vectors, calibration and review."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import INDOOR, OUTDOOR
from .hierarchy import catalog_part, closure, legacy_axes, paths, visible

#: Weights of the leaf, group and major prototypes, the bonus of a node a rule named, and candidates kept.
LEAF, GROUP, MAJOR, RULE_BONUS, KEEP = 0.7, 0.2, 0.1, 0.015, 5
MOST_NODES, MOST_LABELS = 8, 100_000
#: Labels of one matrix product, so that a batch of captions needs bounded memory.
LABEL_CHUNK = 4_096


def entry_text() -> Column:
    return F.concat_ws(" ", F.array("dataset", "motion_id", "description"), F.col("captions"))


def phrases(nodes: DataFrame) -> DataFrame:
    """``(node_id, phrase, head)``: token phrases of every name and alias, each once, of any length."""
    spoken = F.concat(F.array("en"), F.coalesce("aliases_en", F.array().cast("array<string>")), F.coalesce("aliases_zh", F.array().cast("array<string>")))
    told = nodes.where("kind NOT IN ('domain', 'category') OR size(aliases_en) > 0").select(F.col("id").alias("node_id"), F.explode(spoken).alias("alias"))
    split = told.where("alias IS NOT NULL").select("node_id", X.taxonomy_tokens("alias").alias("phrase")).where(F.size("phrase") > 0).distinct()
    return split.withColumn("head", F.col("phrase")[0])


def phrase_matches(entry: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(object_id, node_id, matched, length)``: phrases of nodes found in the text of entries.

    Every token position carries the few tokens that follow it, so the join is on the first token alone and the rest is
    compared in the row; the phrase table of the bounded catalog is broadcast.
    """
    listed = phrases(nodes)
    longest = listed.agg(F.max(F.size("phrase"))).first()[0] or 1
    words = entry.select("object_id", X.taxonomy_tokens(entry_text()).alias("t"))
    at = words.select("object_id", F.explode(F.transform("t", lambda _, k: F.slice(F.col("t"), k + 1, longest))).alias("ahead")).withColumn("head", F.col("ahead")[0])
    hit = at.join(catalog_part(listed), "head").where(F.slice("ahead", F.lit(1), F.size("phrase")) == F.col("phrase"))
    found = hit.select("object_id", "node_id", F.array_join("phrase", " ").alias("phrase"), F.size("phrase").alias("n"))
    han = han_matches(entry, nodes)
    return found.unionByName(han).groupBy("object_id", "node_id").agg(F.array_sort(F.collect_set("phrase")).alias("matched"), F.max("n").alias("length"))


def han_matches(entry: DataFrame, nodes: DataFrame) -> DataFrame:
    """Han aliases of visible-kind action nodes contained in the compacted text: ``(object_id, node_id, phrase, n)``."""
    spoken = F.explode(F.concat(F.array("zh_cn"), F.coalesce("aliases_zh", F.array().cast("array<string>")))).alias("alias")
    alias = nodes.where("asset_taxonomy AND kind = 'action'").select(F.col("id").alias("node_id"), spoken).where(X.has_han("alias")).select("node_id", X.letters_only("alias").alias("alias")).where("alias <> ''").distinct()
    return entry.sparkSession.sql(
        """SELECT object_id, inline(transform(filter(listed, a -> contains(body, a.alias)), a -> struct(a.node_id AS node_id, a.alias AS phrase, length(a.alias) AS n)))
           FROM (SELECT *, (SELECT collect_list(struct(node_id, alias)) FROM {alias}) AS listed FROM {texts})""",
        alias=alias,
        texts=entry.where(X.has_han(entry_text())).select("object_id", X.letters_only(entry_text()).alias("body")),
    )


def specific(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(object_id, selected)``: greedy choice by priority, phrase length and id that skips kin of a chosen node."""
    up = closure(nodes).groupBy("node_id").agg(F.collect_set("ancestor_id").alias("ancestors"))
    known = nodes.select(F.col("id").alias("node_id"), F.coalesce("priority", F.lit(50)).alias("priority")).join(up, "node_id")
    item = F.struct((-F.col("priority")).alias("p"), (-F.col("length")).alias("l"), "node_id", "ancestors", "matched")
    listed = matches.join(catalog_part(known), "node_id").groupBy("object_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    fold = "aggregate(items, filter(items, x -> false), (acc, x) -> IF(exists(acc, c -> array_contains(c.ancestors, x.node_id) OR array_contains(x.ancestors, c.node_id)), acc, array_append(acc, x)))"
    return listed.select("object_id", F.expr(f"slice({fold}, 1, {MOST_NODES})").alias("selected"))


def space_axis(entry: DataFrame) -> DataFrame:
    """``(object_id, space, space_matches)`` by indoor and outdoor keywords among the tokens."""
    words = X.taxonomy_tokens(entry_text())
    found = entry.select("object_id", F.array_intersect(F.array(*map(F.lit, INDOOR)), words).alias("i"), F.array_intersect(F.array(*map(F.lit, OUTDOOR)), words).alias("o"))
    inside, outside = F.size("i") > 0, F.size("o") > 0
    return found.select(
        "object_id",
        F.when(inside & ~outside, "indoor").when(outside & ~inside, "outdoor").otherwise("mixed_or_unspecified").alias("space"),
        F.concat(F.array_sort("i"), F.array_sort("o")).alias("space_matches"),
    )


def participants(dataset: Column) -> Column:
    return F.when(dataset.isin("interhuman", "interx"), "pair").when(dataset.isin("motionxpp", "motionlab"), "single").otherwise("group_or_unknown")


def rule_classification(entry: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(object_id, primary_action_node_id, node_ids, action_category, action_tag, activity_domain, participants, space, classification_confidence)``."""
    axes = legacy_axes(nodes, closure(nodes))
    chosen = specific(phrase_matches(entry, nodes), nodes)
    first = F.col("selected")[0]
    n = F.coalesce(F.size("selected"), F.lit(0))
    joined = (
        entry.select("object_id", participants(F.col("dataset")).alias("participants"))
        .join(space_axis(entry), "object_id")
        .join(chosen, "object_id", "left")
        .withColumn("primary_action_node_id", F.when(F.size("selected") > 0, first["node_id"]))
        .join(catalog_part(axes.withColumnRenamed("node_id", "primary_action_node_id")), "primary_action_node_id", "left")
    )
    size = F.when(F.size("selected") > 0, F.size("selected")).otherwise(0)
    sure = F.least(F.lit(1.0), 0.45 + 0.12 * size + F.when((F.size("selected") > 0) & (first["l"] < -1), 0.12).otherwise(0.0))
    return joined.select(
        "object_id",
        "primary_action_node_id",
        F.coalesce(F.transform("selected", lambda s: s["node_id"]), F.array().cast("array<string>")).alias("node_ids"),
        F.coalesce("category", F.lit("special_actions")).alias("action_category"),
        F.coalesce("tag", F.lit("other")).alias("action_tag"),
        F.coalesce("domain", F.lit("other")).alias("activity_domain"),
        "participants",
        "space",
        F.round(sure, 3).alias("classification_confidence"),
    )


def prototype_vectors(captions: DataFrame, primary: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, leaf, grp, major)``: mean caption vectors of a leaf, its group and its root.

    Stand-in for encoded prototype texts: one map-side combined sum per leaf, rolled up over the closure.
    """
    labels = visible(nodes, leaves_only=True).select(F.col("id").alias("node_id"), F.col("parent_id"))
    rows = captions.where("embedding IS NOT NULL AND size(embedding) > 0").join(primary, "object_id").join(catalog_part(labels.select("node_id")), "node_id")

    def added(batches):
        total: dict[tuple[str, int], tuple[np.ndarray, int]] = {}
        for pdf in batches:
            for (node, dims), own in pdf["embedding"].groupby([pdf["node_id"], pdf["embedding"].map(len)]):
                before, n = total.get((node, dims), (np.zeros(dims), 0))
                total[node, dims] = before + np.stack(own.to_numpy()).astype(np.float64).sum(0), n + len(own)
        for (node, _), (s, n) in total.items():
            yield pd.DataFrame({"node_id": [node], "s": [s.tolist()], "n": [n]})

    # sums of a partition leave it, not the rows of its vectors
    part = rows.select("node_id", "embedding").mapInPandas(added, "node_id string, s array<double>, n bigint")
    sums = part.select("node_id", "n", F.posexplode("s").alias("k", "x")).groupBy("node_id", "k").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))
    up = closure(nodes)
    top = up.groupBy("node_id").agg(F.max_by("ancestor_id", "distance").alias("root_id"))
    rolled = sums.join(catalog_part(labels), "node_id").join(catalog_part(top), "node_id")
    mean = lambda key, name: rolled.groupBy(key, "k").agg((F.sum("s") / F.sum("n")).alias("m")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias(name))
    return labels.join(top, "node_id").join(mean("node_id", "leaf"), "node_id").join(mean("parent_id", "grp"), "parent_id").join(mean("root_id", "major"), "root_id").select("node_id", "leaf", "grp", "major")


def prototype_candidates(captions: DataFrame, prototypes: DataFrame, rule_nodes: DataFrame | None = None, *, keep: int = KEEP) -> DataFrame:
    """``(object_id, rank, node_id, score, leaf_score, group_score, major_score, matched_vec)``: best labels of an object over its captions.

    Scores of a batch of captions are matrix products with chunks of the bounded label matrix; only the best labels of a
    caption leave the worker. ``rule_nodes`` is ``(object_id, node_ids)``. Ties go to the smaller node id and vec_id.
    """
    labels = prototypes.orderBy("node_id").limit(MOST_LABELS + 1).collect()
    if not 2 <= len(labels) <= MOST_LABELS:
        raise ValueError("the label set must hold at least two labels and fit a broadcast")
    names = [r.node_id for r in labels]
    leaf, group, major = (np.array([r[c] for r in labels], np.float64) for c in ("leaf", "grp", "major"))
    combined = LEAF * leaf + GROUP * group + MAJOR * major
    place = {n: k for k, n in enumerate(names)}
    rows = captions.select("vec_id", "object_id", "embedding").where("embedding IS NOT NULL AND size(embedding) > 0 AND object_id IS NOT NULL")
    rows = rows.join(rule_nodes.select("object_id", "node_ids"), "object_id", "left") if rule_nodes is not None else rows.withColumn("node_ids", F.lit(None).cast("array<string>"))

    def run(batches):
        named = np.array(names, object)
        for pdf in batches:
            pdf = pdf[pdf["embedding"].map(len) == combined.shape[1]]
            if not len(pdf):
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            ruled = [(k, place[n]) for k, given in enumerate(pdf["node_ids"]) if given is not None for n in set(given) if n in place]
            by, at = (np.array(z, int) for z in zip(*ruled)) if ruled else (np.zeros(0, int), np.zeros(0, int))
            best, value = np.zeros((len(x), 0), int), np.zeros((len(x), 0))
            for a in range(0, len(names), LABEL_CHUNK):
                score = x @ combined[a : a + LABEL_CHUNK].T
                own = (at >= a) & (at < a + LABEL_CHUNK)
                score[by[own], at[own] - a] += RULE_BONUS
                value = np.concatenate([value, np.round(score, 6)], 1)
                best = np.concatenate([best, np.broadcast_to(np.arange(a, a + score.shape[1]), score.shape)], 1)
                order = np.argsort(-value, axis=1, kind="stable")[:, :keep]
                value, best = np.take_along_axis(value, order, 1), np.take_along_axis(best, order, 1)
            line, best = np.arange(len(x)).repeat(best.shape[1]), best.ravel()
            sides = {name: np.round((x[line] * m[best]).sum(1), 6) for name, m in (("leaf_score", leaf), ("group_score", group), ("major_score", major))}
            yield pd.DataFrame({"object_id": pdf["object_id"].to_numpy()[line], "vec_id": pdf["vec_id"].to_numpy()[line], "node_id": named[best], "score": value.ravel(), **sides})

    sides = ["leaf_score", "group_score", "major_score"]
    hits = rows.select("object_id", "vec_id", "embedding", "node_ids").mapInPandas(run, "object_id string, vec_id bigint, node_id string, score double, " + ", ".join(f"{c} double" for c in sides))
    each = hits.groupBy("object_id", "node_id").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("v"), *sides)).alias("r"))
    order = Window.partitionBy("object_id").orderBy(F.desc("r.score"), "node_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("object_id", "rank", "node_id", F.col("r.score").alias("score"), *[F.col(f"r.{c}").alias(c) for c in sides], (-F.col("r.v")).alias("matched_vec"))


def thresholds(scored: DataFrame) -> DataFrame:
    """One row of exact quantiles of ``score`` and ``margin``; fails on a single candidate upstream."""
    q = lambda c, p: F.round(F.expr(f"percentile({c}, {p})"), 6)
    return scored.agg(q("score", 0.75).alias("high_score"), q("margin", 0.75).alias("high_margin"), q("score", 0.25).alias("medium_score"), q("margin", 0.25).alias("medium_margin"))


def confidence_levels(scored: DataFrame) -> DataFrame:
    """``scored`` with ``level``: high, medium or low against the corpus quantiles (one row, a scalar subquery)."""
    return scored.sparkSession.sql(
        """WITH t AS (SELECT * FROM {cut})
           SELECT s.*, CASE WHEN score >= (SELECT high_score FROM t) AND margin >= (SELECT high_margin FROM t) THEN 'high'
                            WHEN score >= (SELECT medium_score FROM t) AND margin >= (SELECT medium_margin FROM t) THEN 'medium' ELSE 'low' END AS level
           FROM {scored} s""",
        cut=thresholds(scored),
        scored=scored,
    )


def audit_sample(levels: DataFrame, size: int = 100) -> DataFrame:
    """First objects of every level by id."""
    return levels.withColumn("turn", F.row_number().over(Window.partitionBy("level").orderBy("object_id"))).where(F.col("turn") <= size).drop("turn")


def review_queue(levels: DataFrame, size: int = 100) -> DataFrame:
    """``(object_id, reason, reasons)`` in fixed order: low confidence, conflict with the rules, audit sample."""
    picked = audit_sample(levels.select("object_id", "level"), size).select("object_id", F.lit(True).alias("picked"))
    reasons = F.filter(
        F.array(F.when(F.col("level") == "low", "low_confidence"), F.when(F.col("rule_conflict"), "rule_model_conflict"), F.when(F.col("picked"), F.concat("level", F.lit("_confidence_audit_sample")))),
        lambda r: r.isNotNull(),
    )
    return levels.join(picked, "object_id", "left").withColumn("reasons", reasons).where(F.size("reasons") > 0).select("object_id", F.col("reasons")[0].alias("reason"), "reasons")


def assignment_report(rows: DataFrame) -> DataFrame:
    """``(dimension, value, n)`` counters of dataset, primary node, tag, method status and conflicts in one aggregation."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in ("dataset", "primary_node", "action_tag", "confidence_level", "rule_conflict")])
    return rows.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def prototype_texts(nodes: DataFrame) -> DataFrame:
    """``(node_id, leaf_text, group_text, major_text)`` of the visible leaves, for an encoder."""
    full = closure(nodes)
    named = paths(full, nodes)
    aliases = F.array_distinct(F.filter(F.concat(F.coalesce("aliases_en", F.array().cast("array<string>")), F.coalesce("aliases_zh", F.array().cast("array<string>"))), lambda a: F.length(a) > 0))
    english = F.array_distinct(F.filter(F.coalesce("aliases_en", F.array().cast("array<string>")), lambda a: F.length(a) > 0))
    rows = visible(nodes, leaves_only=True).withColumn("node_id", F.col("id")).join(named, "node_id").withColumn("all_aliases", aliases).withColumn("en_aliases", english)
    said = F.concat(F.lit("动作分类："), F.array_join("path", " > "), F.lit("。动作："), F.col("zh_cn"), F.lit("。"), F.when(F.size("all_aliases") > 0, F.concat(F.lit("同义描述："), F.array_join("all_aliases", ", "), F.lit("。"))).otherwise(""))
    extra = F.when(F.size("en_aliases") > 0, F.concat(F.lit(" English aliases: "), F.array_join("en_aliases", ", "), F.lit("."))).otherwise("")
    root = F.col("path")[0]
    return rows.select("node_id", F.concat(said, extra).alias("leaf_text"), F.concat(F.lit("动作类别："), F.col("path")[F.size("path") - 2], F.lit("。所属领域："), root, F.lit("。")).alias("group_text"), F.concat(F.lit("动作领域："), root, F.lit("。")).alias("major_text"))
