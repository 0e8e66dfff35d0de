"""From rule matches and prototype candidates to classifications: full rule output, chosen leaf, margin, conflict, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import participants, phrase_matches, space_axis, specific
from .hierarchy import catalog_part, closure, legacy_axes, paths

#: Prefix of the ids of the leaves that assets are tagged with.
LEAF_PREFIX = "asset_tag_"
METHOD = "semantic_leaf_v2"
_NODE = "struct<id: string, label: string, en: string, kind: string, path: array<string>, role: string, matched_phrases: array<string>, source_refs: array<string>>"


#: What label vectors and caption vectors must both say of themselves.
CONTRACT = {"encoder_family": "qwen3-embedding", "pooling": "last_token", "normalized": True}


class ContractError(ValueError):
    """Label vectors and caption vectors that don't belong together."""


def check_contract(labels: dict, captions: dict, label_rows: int, caption_rows: int, dimension: int, contract: dict = CONTRACT) -> None:
    """Raise unless two manifests name the same encoder and the tables hold what their manifests say."""
    for name, manifest in (("label", labels), ("caption", captions)):
        for key, value in contract.items():
            if manifest.get(key) != value:
                raise ContractError(f"{name} vectors: {key} is {manifest.get(key)!r}, not {value!r}")
    if labels.get("encoding_role") != "document":
        raise ContractError("label vectors are not of document texts")
    if labels.get("model_config_sha256") != captions.get("model_config_sha256"):
        raise ContractError("label and caption vectors are of different model configurations")
    told = (int(labels.get("label_count", label_rows)), int(captions.get("caption_count", caption_rows)), int(labels.get("dimension", dimension)))
    if told != (label_rows, caption_rows, dimension):
        raise ContractError(f"manifests name {told}, the tables hold {(label_rows, caption_rows, dimension)}")


def node_details(nodes: DataFrame) -> DataFrame:
    """``(node_id, label, en, kind, path, source_refs, category, tag, domain)`` of every node."""
    full = closure(nodes)
    told = nodes.select(F.col("id").alias("node_id"), F.col("zh_cn").alias("label"), "en", "kind", F.coalesce("source_refs", F.array().cast("array<string>")).alias("source_refs"))
    return told.join(paths(full, nodes), "node_id").join(legacy_axes(nodes, full), "node_id")


def _keywords(dataset: Column, shared: Column) -> Column:
    return F.when(shared.isin("single", "pair") & (F.length(dataset) > 0), F.array(dataset)).otherwise(F.array().cast("array<string>"))


def rule_records(entry: DataFrame, nodes: DataFrame, version: str) -> DataFrame:
    """``(object_id, classification)``: all that the rules tell about an entry.

    The struct holds version, axes, their labels (the values themselves where the catalog names none), primary node, chosen
    nodes with paths, roles and phrases, matched keywords and confidence.
    """
    chosen = specific(phrase_matches(entry, nodes), nodes)
    listed = chosen.select("object_id", F.posexplode("selected").alias("at", "x")).select("object_id", "at", "x.node_id", F.col("x.l").alias("l"), F.col("x.matched").alias("matched"))
    full = listed.join(catalog_part(node_details(nodes)), "node_id")
    role = F.when(F.col("at") == 0, "primary").otherwise("secondary")
    node = F.struct("at", "l", "category", "tag", "domain", F.struct(F.col("node_id").alias("id"), "label", "en", "kind", "path", role.alias("role"), F.col("matched").alias("matched_phrases"), "source_refs").alias("node"))
    held = full.groupBy("object_id").agg(F.sort_array(F.collect_list(node)).alias("chosen"))
    row = (
        entry.select("object_id", "dataset", participants(F.col("dataset")).alias("participants"))
        .join(space_axis(entry), "object_id")
        .join(held, "object_id", "left")
        .withColumn("chosen", F.coalesce("chosen", F.filter(F.array(F.lit(None).cast(full.groupBy().agg(F.collect_list(node).alias("c")).schema["c"].dataType.elementType)), lambda x: F.lit(False))))
        .withColumn("first", F.get("chosen", F.lit(0)))
    )
    n, first = F.size("chosen"), F.col("first")
    axes = F.create_map(
        F.lit("action_category"), F.coalesce(first["category"], F.lit("special_actions")), F.lit("action_tag"), F.coalesce(first["tag"], F.lit("other")),
        F.lit("participants"), F.col("participants"), F.lit("space"), F.col("space"), F.lit("activity_domain"), F.coalesce(first["domain"], F.lit("other")),
    )
    nothing = F.array().cast("array<string>")
    keywords = F.create_map(
        F.lit("action_category"), F.when(n > 0, F.array(first["category"])).otherwise(nothing), F.lit("action_tag"), F.when(n > 0, first["node"]["matched_phrases"]).otherwise(nothing),
        F.lit("participants"), _keywords(F.col("dataset"), F.col("participants")), F.lit("space"), F.col("space_matches"),
    )
    sure = F.round(F.least(F.lit(1.0), 0.45 + 0.12 * n + F.when((n > 0) & (first["l"] < -1), 0.12).otherwise(0.0)), 3)
    return row.select(
        "object_id",
        F.struct(
            F.lit(version).alias("taxonomy_version"),
            axes.alias("taxonomy"),
            axes.alias("taxonomy_labels"),
            first["node"]["id"].alias("primary_action_node_id"),
            F.transform("chosen", lambda c: c["node"]).alias("action_nodes"),
            keywords.alias("matched_keywords"),
            sure.alias("classification_confidence"),
        ).alias("classification"),
    )


def reused(entry: DataFrame, assigned: DataFrame, rules: DataFrame, version: str) -> DataFrame:
    """``(object_id, classification, cached)``: the stored result of this version, else the rules'.

    Participants of a stored result always follow the dataset.
    """
    fields = rules.schema["classification"].dataType.names
    stored = assigned.where(F.col("classification.taxonomy_version") == version).select("object_id", F.col("classification").alias("held"))
    shared = participants(F.col("dataset"))
    put = lambda m, value: F.map_concat(F.map_filter(F.coalesce(m, F.create_map().cast(value[1])), lambda k, _: k != "participants"), F.create_map(F.lit("participants"), value[0]))
    text, lists = "map<string,string>", "map<string,array<string>>"
    fresh = {
        "taxonomy": put(F.col("held.taxonomy"), (shared, text)),
        "taxonomy_labels": put(F.col("held.taxonomy_labels"), (shared, text)),
        "matched_keywords": put(F.col("held.matched_keywords"), (_keywords(F.col("dataset"), shared), lists)),
    }
    kept = F.struct(*[fresh.get(f, F.col(f"held.{f}")).alias(f) for f in fields]).cast(rules.schema["classification"].dataType.simpleString())
    row = entry.select("object_id", "dataset").join(stored, "object_id", "left").join(rules, "object_id", "left")
    return row.select("object_id", F.when(F.col("held").isNotNull(), kept).otherwise(F.col("classification")).alias("classification"), F.col("held").isNotNull().alias("cached"))


def leaf_ids(action_nodes: Column, prefix: str = LEAF_PREFIX) -> Column:
    """Ids of the nodes of a classification that are asset leaves, each once, in order."""
    ids = F.transform(F.coalesce(action_nodes, F.array().cast(f"array<{_NODE}>")), lambda n: n["id"])
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: F.startswith(i, F.lit(prefix)))))


def ranked_candidates(hits: DataFrame) -> DataFrame:
    """``(object_id, candidates)``: the rows of ``classify.prototype_candidates`` of an object, best first."""
    fields = [c for c in hits.columns if c not in ("object_id", "rank")]
    return hits.groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("candidates"))


def margin(candidates: Column) -> Column:
    """How far the first candidate is ahead of the second, which counts as 0 where there is none."""
    return F.round(F.get(candidates, F.lit(0))["score"] - F.coalesce(F.get(candidates, F.lit(1))["score"], F.lit(0.0)), 6)


def rule_conflict(expected: Column, chosen: Column) -> Column:
    """Whether the rules named leaves and the chosen one isn't among them."""
    return (F.size(expected) > 0) & ~F.array_contains(expected, chosen)


def model_struct(candidates: Column, name: str, level: Column, caption: Column) -> Column:
    """What is kept about the model's choice."""
    first = F.get(candidates, F.lit(0))
    side = lambda f: F.coalesce(first[f], F.lit(0.0))
    return F.struct(
        F.lit(name).alias("name"), F.round(side("score"), 6).alias("score"), side("leaf_score").alias("leaf_score"), side("leaf_score").alias("prototype_score"),
        side("group_score").alias("group_score"), side("major_score").alias("major_score"), F.coalesce(margin(candidates), F.lit(0.0)).alias("margin"),
        F.transform(candidates, lambda c: c["node_id"]).alias("candidate_node_ids"), F.coalesce(caption, F.lit("")).alias("matched_caption"),
        level.alias("confidence_level"), F.concat(level, F.lit("_confidence")).alias("status"),
    )


def scored_candidates(hits: DataFrame, rules: DataFrame, prefix: str = LEAF_PREFIX) -> DataFrame:
    """``(object_id, candidates, node_id, score, margin, expected, rule_conflict)`` of every object with two candidates.

    ``rules`` is ``(object_id, classification)``; the leaves it names are the expected ones. One candidate alone is an error
    upstream: no margin can be told.
    """
    held = ranked_candidates(hits)
    named = rules.select("object_id", leaf_ids(F.col("classification.action_nodes"), prefix).alias("expected"))
    row = held.join(named, "object_id", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))
    first = F.get("candidates", F.lit(0))
    return row.where(F.size("candidates") > 1).select(
        "object_id", "candidates", first["node_id"].alias("node_id"), first["score"].alias("score"), margin(F.col("candidates")).alias("margin"), "expected", rule_conflict(F.col("expected"), first["node_id"]).alias("rule_conflict")
    )


def apply_semantic(levels: DataFrame, rules: DataFrame, nodes: DataFrame, captions: DataFrame, *, model: str, version: str, prefix: str = LEAF_PREFIX) -> DataFrame:
    """``(object_id, classification)``: the rules' result with the best semantic leaf, its axes and the model's account.

    ``levels`` are ``scored_candidates`` with their ``level``; ``captions`` is ``(vec_id, caption)``. Participants, space and
    keywords stay the rules'. An object whose best candidate is no asset leaf keeps the rules' result.
    """
    best = levels.withColumn("vec_id", F.get("candidates", F.lit(0))["matched_vec"]).join(captions.select("vec_id", "caption"), "vec_id", "left")
    row = rules.join(best, "object_id", "left").join(catalog_part(node_details(nodes).where(F.startswith("node_id", F.lit(prefix)))), "node_id", "left")
    c = F.col("classification")
    replaced = F.create_map(F.lit("action_category"), F.col("category"), F.lit("action_tag"), F.col("tag"), F.lit("activity_domain"), F.col("domain"))
    put = lambda m: F.map_concat(F.map_filter(m, lambda k, _: ~k.isin("action_category", "action_tag", "activity_domain")), replaced)
    node = F.struct(F.col("node_id").alias("id"), "label", "en", "kind", "path", F.lit("primary").alias("role"), F.array().cast("array<string>").alias("matched_phrases"), "source_refs")
    model_ = model_struct(F.col("candidates"), model, F.col("level"), F.col("caption"))
    made = F.struct(
        F.lit(version).alias("taxonomy_version"), put(c["taxonomy"]).alias("taxonomy"), put(c["taxonomy_labels"]).alias("taxonomy_labels"), F.col("node_id").alias("primary_action_node_id"),
        F.array(node).alias("action_nodes"), c["matched_keywords"].alias("matched_keywords"), F.round("score", 3).alias("classification_confidence"), F.lit(METHOD).alias("classification_method"),
        F.col("level").alias("confidence_level"), F.col("rule_conflict").alias("rule_conflict"), model_.alias("classification_model"),
    )
    kept = F.struct(*[(c[f] if f in rules.schema["classification"].dataType.names else F.lit(None)).alias(f) for f in ("taxonomy_version", "taxonomy", "taxonomy_labels", "primary_action_node_id", "action_nodes", "matched_keywords", "classification_confidence", "classification_method", "confidence_level", "rule_conflict", "classification_model")])
    # the label is null where the best candidate isn't an asset leaf
    return row.select("object_id", F.when(F.col("label").isNotNull(), made).otherwise(kept).alias("classification"))


def ordered_counts(counters: DataFrame) -> DataFrame:
    """``(dimension, value, n)`` counters with ``place``: most common first, ties by value."""
    return counters.withColumn("place", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc_nulls_last("value"))))


def summary(classified: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(measure, value)``: entries, classified ones, their rates, and how many leaves are used, in one aggregation.

    ``classified`` is ``(object_id, classification)`` with null for entries without a result; ``leaves`` are ``(id)``.
    """
    first = F.col("classification.primary_action_node_id")
    flagged = F.coalesce("classification.rule_conflict", F.lit(False)) if "rule_conflict" in classified.schema["classification"].dataType.names else F.lit(False)
    told = classified.agg(F.count("*").alias("entries"), F.count(first).alias("classified"), F.count_distinct(first).alias("used"), F.count_if(flagged).alias("conflicts"))
    labels = leaves.agg(F.count_distinct("id").alias("labels"))
    both = told.join(F.broadcast(labels))
    total = F.greatest("entries", F.lit(1))
    measures = {
        "entry_count": F.col("entries"), "classified_count": F.col("classified"), "unclassified_count": F.col("entries") - F.col("classified"),
        "unclassified_rate": F.round((F.col("entries") - F.col("classified")) / total, 6), "leaf_label_count": F.col("labels"), "used_leaf_label_count": F.col("used"),
        "empty_leaf_label_count": F.col("labels") - F.col("used"), "leaf_coverage_rate": F.round(F.col("classified") / total, 6), "rule_conflict_count": F.col("conflicts"),
    }
    return both.select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in measures.items()])))


def node_counts(classified: DataFrame) -> DataFrame:
    """``(dimension, value, n)`` of primary nodes, all nodes and tags of classifications."""
    c = F.col("classification")
    primary = F.filter(F.array(c["primary_action_node_id"]), lambda x: x.isNotNull())
    every = F.coalesce(F.transform(c["action_nodes"], lambda n: n["id"]), F.array().cast("array<string>"))
    tag = F.filter(F.array(F.element_at(c["taxonomy"], "action_tag")), lambda x: x.isNotNull())
    named = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("value")))
    pairs = F.concat(named("primary_node", primary), named("any_node", every), named("tag", tag))
    return classified.where(c.isNotNull()).select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def first_warnings(warnings: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first warnings of a build; the number of all of them is a count of its own."""
    return warnings.orderBy(*order).limit(max(int(most), 0))
