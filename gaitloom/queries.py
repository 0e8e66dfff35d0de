"""The queries of the entry module: one callable (spark, directory) -> DataFrame a name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import audit, classify, entries as E, evaluate, facets, hierarchy as H, postings as P, ranking as R, respond, semantic
from .oracles import BASE, CASES, DENSE, LEAVES, LIB_FILTERS, LOOKED_UP, QUERIES, VERSION
from .plans.library import Browse, browse
from .plans.runtime import table
from .plans.search import Request, search
from .sources.files import index_records, roll_degrees
from .streaming.incremental import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def _entry(s, d):
    return E.entries(table(s, d, "motion_index"))


def _nodes(s, d):
    return table(s, d, "taxonomy_node")


def _force(s, d):
    return E.assignments(table(s, d, "motion_entry"))


def _index(s, d):
    return P.ensure_index(s, f"{d}/motion_index.parquet", lambda: _entry(s, d))


def _lexical(s, d):
    return R.lexical_scores(_index(s, d), R.query_table(s, QUERIES))


def _library(s, d):
    return facets.library(_entry(s, d), _force(s, d), _nodes(s, d))


@query
def asset_entries(s, d):
    return _entry(s, d).select("object_id", "record_id", "dataset", "motion_id", "source_title", "series_key", "description", F.size("captions").alias("n_captions"), "frame_count")


@query
def scan_filter_assets(s, d):
    return facets.filtered(_entry(s, d), {"dataset": " InterX "}).where("frame_count IS NOT NULL").select("object_id", "motion_id", "frame_count")


@query
def normalize_caption(s, d):
    rows = table(s, d, "motion_index").select("record_id", F.posexplode("captions").alias("k", "c"))
    return rows.select("record_id", F.col("k").cast("bigint").alias("k"), X.clean_caption("c").alias("caption")).withColumn("searchable", X.searchable(F.col("caption")))


@query
def explode_captions_dedup(s, d):
    return E.caption_rows(table(s, d, "motion_index"))


@query
def tokenize_terms(s, d):
    return P.postings(_entry(s, d))


@query
def doc_length(s, d):
    return P.token_lengths(_entry(s, d))


@query
def idf_table(s, d):
    entry = _entry(s, d)
    return P.idf(P.postings(entry), entry.count()).withColumn("idf", F.round("idf", 6))


@query
def bm25_search(s, d):
    return R.lexical_top(_lexical(s, d), 50)


@query
def fts_candidates(s, d):
    return R.candidates(_index(s, d), R.query_table(s, QUERIES), 10**9).select("query_id", "object_id")


@query
def fts_limited(s, d):
    return R.candidates(_index(s, d), R.query_table(s, QUERIES), 40)


@query
def limited_search(s, d):
    return R.lexical_top(R.lexical_scores(_index(s, d), R.query_table(s, QUERIES), limit=100), 10)


@query
def entries_page(s, d):
    scored = _lexical(s, d)
    # one row a query, joined to the page instead of a window over all matches
    about = scored.groupBy("query_id").agg(F.max("score").alias("best"), F.count_if(F.col("dataset") == "motionxpp").alias("total"))
    kept = scored.where("dataset = 'motionxpp'")
    placed = R.top(kept, 40, [F.desc("score"), F.asc("dataset"), F.asc("motion_id"), F.asc("object_id")], rank="place").where("place > 20").join(about, "query_id")
    return placed.select("query_id", "object_id", "score", R.pooled(F.col("score"), F.col("best")).alias("pooled_score"), "total", "place")


@query
def dataset_summary(s, d):
    return _entry(s, d).groupBy("dataset").agg(F.count("*").alias("n")).orderBy("dataset")


@query
def sort_frame_count_desc(s, d):
    return R.page(_entry(s, d), sort="frame_count_desc", offset=40, limit=20).select("object_id", "dataset", "motion_id", "frame_count")


@query
def page_counts(s, d):
    return _entry(s, d).groupBy("dataset").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 20.0)).alias("pages"))


@query
def left_join_assignments(s, d):
    c = F.col("classification")
    return E.classified(_entry(s, d), _force(s, d)).select("object_id", c["primary_action_node_id"].alias("node_id"), c["taxonomy_version"].alias("version"), F.round(c["classification_confidence"], 6).alias("confidence"))


@query
def anti_unclassified(s, d):
    return _entry(s, d).select("object_id").join(table(s, d, "motion_entry"), "object_id", "left_anti")


@query
def semi_known_ids(s, d):
    return audit.known_and_unknown(table(s, d, "semantic_index"), _entry(s, d).select("object_id"))[0].select("vec_id")


@query
def unknown_ids(s, d):
    ids = table(s, d, "semantic_index").where("object_id IS NOT NULL").select("object_id").distinct()
    return audit.known_and_unknown(_entry(s, d), ids)[1]


def _dense(s, d, k):
    rows = table(s, d, "semantic_index")
    wanted = {v for own in DENSE.values() for v in own}
    held = {r.vec_id: r.embedding for r in rows.where(F.col("vec_id").isin(*wanted)).select("vec_id", "embedding").collect() if r.embedding is not None}
    vectors = {name: [held[v] for v in own if v in held] for name, own in DENSE.items() if own[0] in held}
    return R.top(R.dense_scores(rows, vectors, keep=k), k, [F.desc(F.round("score", 9)), F.asc("vec_id")])


@query
def dense_topk(s, d):
    return _dense(s, d, 50).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query
def best_caption_per_object(s, d):
    return R.best_of_object(_dense(s, d, 1200).where("object_id IS NOT NULL")).select("query_id", "object_id", "rank", F.round("score", 6).alias("score"))


@query
def full_outer_fusion(s, d):
    lexical = R.lexical_top(_lexical(s, d).where(F.col("query_id").isin(*DENSE)), 300)
    dense = R.best_of_object(_dense(s, d, 1200).where("object_id IS NOT NULL"))
    return R.fuse(lexical, dense, _entry(s, d)).select("query_id", "object_id", F.round("fused", 9).alias("fused"))


def _shortlist(s, d):
    best = R.lexical_top(_lexical(s, d), 20).withColumnRenamed("score", "base_score").select("query_id", "object_id", "base_score", "rank")
    said = s.createDataFrame(list(QUERIES), "query_id string, query string")
    return best.join(_entry(s, d), "object_id").join(F.broadcast(said), "query_id")


@query
def rerank_combine(s, d):
    r = R.rerank(_shortlist(s, d))
    return r.select("query_id", "object_id", F.round("title_score", 6).alias("title_score"), F.round("caption_score", 6).alias("caption_score"), "exact_source_match", F.round("reranker_score", 6).alias("reranker_score"))


@query
def diversify_mmr(s, d):
    return R.diversify(_shortlist(s, d).withColumn("score", F.col("base_score")))


@query
def library_rerank_merge(s, d):
    scored = R.lexical_top(_lexical(s, d), 300).drop("rank")
    places = R.diversify(_shortlist(s, d).withColumn("score", F.col("base_score")))
    return R.merge_reranked(scored.join(places, ["query_id", "object_id"], "left")).where("position <= 40").select("query_id", "object_id", "position")


@query
def sample_seeded(s, d):
    return R.sample(R.lexical_top(_lexical(s, d), 200), 20, 0.3, "seed7").select("query_id", "object_id", "place")


@query
def running_weight(s, d):
    # the cumulative weights of an exploratory draw over the head of a ranked list
    head = R.lexical_top(_lexical(s, d), 50).withColumn("weight", F.exp(F.col("score") / 10.0))
    return audit.running_total(head, ["query_id"], [F.asc("rank")], "weight").select("query_id", "object_id", F.round("cumulative", 4).alias("cumulative"))


@query
def hierarchy_closure(s, d):
    return H.closure(_nodes(s, d))


@query
def hierarchy_roots(s, d):
    return H.roots(H.closure(_nodes(s, d)))


@query
def hierarchy_path(s, d):
    n = _nodes(s, d)
    return H.paths(H.closure(n), n).select("node_id", F.array_join("path", " > ").alias("path"))


@query
def hierarchy_lint(s, d):
    n = _nodes(s, d)
    return H.lint(n, H.closure(n), deepest=2)


@query
def legacy_axes(s, d):
    n = _nodes(s, d)
    return H.legacy_axes(n, H.closure(n))


@query
def visible_leaves(s, d):
    return H.visible(_nodes(s, d), leaves_only=True).select("id", "en")


@query
def catalog_counts(s, d):
    return _nodes(s, d).groupBy("kind").agg(F.count("*").alias("n"))


@query
def node_sources(s, d):
    return _nodes(s, d).select("id", F.explode("source_refs").alias("source")).groupBy("source").agg(F.count_distinct("id").alias("n"))


@query
def catalog_flatten(s, d):
    n = _nodes(s, d).select("id", "parent_id", "kind", "zh_cn")
    tags = n.where("kind = 'action'").groupBy(F.col("parent_id").alias("g")).agg(F.sort_array(F.collect_list("zh_cn")).alias("tags"))
    groups = n.where("kind = 'tag_group'").join(tags, F.col("id") == F.col("g")).groupBy(F.col("parent_id").alias("m")).agg(F.collect_list(F.struct(F.col("zh_cn").alias("name"), F.lit("").alias("focus"), "tags")).alias("groups"))
    tree = n.where("kind = 'major'").join(groups, F.col("id") == F.col("m")).select(F.col("zh_cn").alias("major"), F.lit("").alias("summary"), "groups")
    return H.flatten_catalog(tree)


@query
def tree_text_filter(s, d):
    n = _nodes(s, d)
    return H.text_filter(n, H.closure(n), " Walk ")


@query
def subtree_counts(s, d):
    n = _nodes(s, d)
    tagged = _library(s, d).select("object_id", F.explode("direct").alias("node_id"))
    return H.subtree_counts(H.closure(n), tagged, n)


@query
def library_filter_node(s, d):
    node = _nodes(s, d).where("en = 'Straight walks'").select("id").first()
    return facets.filtered(_library(s, d), {"dataset": "motionxpp", "space": "indoor", "action_node": node.id if node else "?"}).select("object_id", "dataset", "motion_id")


@query
def facets_default(s, d):
    return facets.facet_counts(_library(s, d), {})


@query
def facets_self_excluding(s, d):
    return facets.facet_counts(_library(s, d), LIB_FILTERS)


@query
def facets_sparse(s, d):
    return facets.sparse(facets.facet_counts(_library(s, d), LIB_FILTERS), _nodes(s, d)).select("facet", "value", "n")


@query
def rule_phrase_match(s, d):
    return classify.phrase_matches(_entry(s, d), _nodes(s, d)).select("object_id", "node_id", F.array_join("matched", "|").alias("matched"), "length")


@query
def specificity_select(s, d):
    n = _nodes(s, d)
    return classify.specific(classify.phrase_matches(_entry(s, d), n), n).select("object_id", F.transform("selected", lambda x: x["node_id"]).alias("node_ids"))


@query
def rule_classification(s, d):
    return classify.rule_classification(_entry(s, d), _nodes(s, d))


@query
def space_keyword_axis(s, d):
    return classify.space_axis(_entry(s, d)).select("object_id", "space")


def _candidates(s, d):
    n, captions = _nodes(s, d), table(s, d, "semantic_index")
    primary = _force(s, d).select("object_id", F.col("classification.primary_action_node_id").alias("node_id")).where("node_id IS NOT NULL")
    rules = _force(s, d).select("object_id", F.transform("classification.action_nodes", lambda x: x["id"]).alias("node_ids"))
    return classify.prototype_candidates(captions, classify.prototype_vectors(captions, primary, n), rules)


@query
def prototype_classify(s, d):
    return _candidates(s, d).drop("group_score", "major_score")


def _chosen(s, d):
    """Candidates of the prototypes against the leaves that the delivered results name."""
    return semantic.scored_candidates(_candidates(s, d), _force(s, d), LEAVES)


@query
def margins(s, d):
    return _chosen(s, d).select("object_id", "node_id", "score", "margin")


@query
def rule_conflicts(s, d):
    return _chosen(s, d).select("object_id", "node_id", F.array_join("expected", "|").alias("expected"), "rule_conflict")


@query
def semantic_levels(s, d):
    return classify.confidence_levels(_chosen(s, d)).select("object_id", "level")


@query
def semantic_review(s, d):
    return classify.review_queue(classify.confidence_levels(_chosen(s, d))).select("object_id", "reason", F.array_join("reasons", ",").alias("reasons"))


def _applied(s, d):
    n = _nodes(s, d)
    rules = semantic.rule_records(_entry(s, d), n, VERSION)
    levels = classify.confidence_levels(_chosen(s, d))
    return semantic.apply_semantic(levels, rules, n, table(s, d, "semantic_index"), model="own-encoder", version=VERSION, prefix=LEAVES)


@query
def apply_semantic(s, d):
    c, m = F.col("classification"), F.col("classification.classification_model")
    axes = [c["taxonomy"][a].alias(a) for a in ("action_category", "action_tag", "activity_domain", "participants", "space")]
    model = [m["margin"].alias("margin"), F.array_join(m["candidate_node_ids"], "|").alias("candidates"), m["status"].alias("status"), m["matched_caption"].alias("matched_caption")]
    return _applied(s, d).where("classification.classification_method IS NOT NULL").select("object_id", c["primary_action_node_id"].alias("node_id"), *axes, F.array_join(F.get(c["action_nodes"], F.lit(0))["path"], " > ").alias("path"), c["classification_confidence"].alias("confidence"), *model)


@query
def rule_records(s, d):
    c = F.col("classification")
    nodes = F.array_join(F.transform(c["action_nodes"], lambda n: F.concat_ws("/", n["role"], n["id"], F.array_join(n["path"], ">"), F.array_join(n["matched_phrases"], "+"))), "|")
    return semantic.rule_records(_entry(s, d), _nodes(s, d), VERSION).select("object_id", nodes.alias("nodes"), F.array_join(c["matched_keywords"]["action_tag"], "+").alias("tag_keywords"), F.array_join(c["matched_keywords"]["participants"], "+").alias("participant_keywords"), c["classification_confidence"].alias("confidence"))


@query
def reused_classification(s, d):
    entry = _entry(s, d)
    kept = semantic.reused(entry, _force(s, d), semantic.rule_records(entry, _nodes(s, d), VERSION), VERSION)
    return kept.select("object_id", "cached", F.col("classification.taxonomy")["participants"].alias("participants"), F.when(F.col("cached"), F.col("classification.primary_action_node_id")).alias("cached_node"))


@query
def rule_leaf_ids(s, d):
    return _force(s, d).select("object_id", F.array_join(semantic.leaf_ids(F.col("classification.action_nodes"), LEAVES), "|").alias("leaves"))


@query
def assignment_summary(s, d):
    return semantic.summary(E.classified(_entry(s, d), _force(s, d)), H.visible(_nodes(s, d), leaves_only=True)).withColumn("value", F.round("value", 6))


@query
def ordered_counts(s, d):
    return semantic.ordered_counts(semantic.node_counts(E.classified(_entry(s, d), _force(s, d)))).where("place <= 25")


def _looked_up(s, d):
    rows = table(s, d, "semantic_index").where(F.col("vec_id").isin(*LOOKED_UP) & F.col("object_id").isNotNull())
    return respond.lookup(_entry(s, d), ["no such id", *(r.object_id for r in rows.select("object_id").collect())])


@query
def entry_lookup(s, d):
    return _looked_up(s, d).select("object_id", "dataset", "motion_id", "description")


@query
def entry_full(s, d):
    r = respond.full(_looked_up(s, d), BASE)
    return r.select("object_id", "animal", "track_name", "source_glb", F.col("preview.download_url").alias("preview_url"), F.col("preview.available").alias("available"), F.col("_links.self").alias("self"), F.col("model.download_path").alias("download_path"), F.col("model.filename").alias("filename"), "has_icon")


@query
def entry_compact(s, d):
    r = respond.compact(_entry(s, d))
    return r.select("object_id", F.size("captions").alias("n_captions"), F.col("preview.download_path").alias("preview_path"), F.col("model.rest_download_path").alias("model_path"), F.col("model.filename").alias("filename"), F.col("model.lazy").alias("lazy"))


@query
def search_items(s, d):
    top = R.lexical_top(_lexical(s, d), 10)
    best = top.groupBy("query_id").agg(F.max("score").alias("best"))
    rows = top.join(best, "query_id").join(_entry(s, d).select("object_id", "description", "frame_count"), "object_id")
    r = respond.search_items(rows.withColumn("motion_id", F.col("motion_id")), BASE, "best")
    return r.select("object_id", "rank", "score", "pooled_score", "frame_count", F.col("glb.url").alias("url"), F.col("glb.filename").alias("filename"), F.col("glb.content_type").alias("content_type"), F.col("preview.url").alias("preview_url"), F.col("model.rest_download_path").alias("model_path"))


@query
def response_rows(s, d):
    items = respond.search_items(R.lexical_top(_lexical(s, d), 5).join(_entry(s, d).select("object_id", "description", "frame_count"), "object_id").withColumn("best", F.col("score")), BASE, "best")
    body = items.groupBy().agg(F.to_json(F.struct(F.collect_list(F.struct(*items.columns)).alias("results"))).alias("body"))
    return respond.response_items(body).select("object_id", "rank", respond.download_url("http://other/").alias("url"))


@query
def search_texts(s, d):
    return table(s, d, "motion_index").select("record_id", F.explode("captions").alias("c")).where(X.has_han("c")).select("record_id", "c", X.search_text("c").alias("said"))


def _some_number(x):
    """A number that follows from a text, for stand-ins of files."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 4), 16, 10).cast("int")


@query
def preview_resolve(s, d):
    entry = _entry(s, d)
    root = "/previews"
    # every third entry has a preview file, every other third its older form, some of them too small to be one
    files = audit.preview_paths(entry, root).withColumn("h", _some_number(F.col("object_id"))).where("h % 3 < 2").select(F.when(F.col("h") % 3 == 0, F.col("canonical_path")).otherwise(F.col("legacy_path")).alias("path"), (F.col("h") % 40).alias("length"))
    return audit.resolve_previews(entry, files, root).select("object_id", "preview_path")


def _scored(s, d):
    model = F.col("classification.classification_model")
    rows = _force(s, d).select("object_id", F.round(model["score"], 6).alias("score"), F.round(model["margin"], 6).alias("margin"), F.coalesce("classification.rule_conflict", F.lit(False)).alias("rule_conflict"))
    return rows.where("score IS NOT NULL AND margin IS NOT NULL")


@query
def confidence_thresholds(s, d):
    return classify.thresholds(_scored(s, d))


@query
def confidence_levels(s, d):
    return classify.confidence_levels(_scored(s, d)).select("object_id", "level")


@query
def audit_sample(s, d):
    return classify.audit_sample(classify.confidence_levels(_scored(s, d))).select("object_id", "level")


@query
def review_queue(s, d):
    return classify.review_queue(classify.confidence_levels(_scored(s, d))).select("object_id", "reason", F.array_join("reasons", ",").alias("reasons"))


@query
def assignment_report(s, d):
    c = F.col("classification")
    rows = E.classified(_entry(s, d), _force(s, d)).select("dataset", c["primary_action_node_id"].alias("primary_node"), c["taxonomy"]["action_tag"].alias("action_tag"), c["confidence_level"].alias("confidence_level"), c["rule_conflict"].cast("string").alias("rule_conflict"))
    return classify.assignment_report(rows)


@query
def prototype_texts(s, d):
    return classify.prototype_texts(_nodes(s, d))


@query
def stable_ids(s, d):
    v = lambda c: F.coalesce(c, F.lit(""))
    return table(s, d, "motion_index").select("record_id", F.sha2(F.concat_ws(":", v("dataset"), v("motion_id"), v("source_motion")), 256).alias("object_hash"), H.stable_id("tag", v("dataset"), v("motion_id")).alias("tag_id"))


@query
def series_dup_rate(s, d):
    key = F.when(F.col("series_key") != "", F.col("series_key")).otherwise(F.concat("dataset", F.lit("/"), F.lower("motion_id")))
    return _entry(s, d).groupBy("dataset").agg(F.round((F.count("*") - F.count_distinct(key)) / F.greatest(F.count("*"), F.lit(1)), 6).alias("duplicate_rate"))


def _metrics(s, d):
    runs = R.lexical_top(_lexical(s, d), 50).join(_entry(s, d).select("object_id", "description"), "object_id")
    rows = [(k, lang, kind, [], [p], [], [f], None) for k, _, lang, kind, p, f in CASES]
    cases = s.createDataFrame(rows, "query_id string, language string, query_type string, relevant_ids array<string>, patterns array<string>, forbidden_ids array<string>, forbidden_patterns array<string>, relevant_total int")
    return evaluate.query_metrics(evaluate.relevance(runs, cases))


@query
def eval_metrics(s, d):
    r = _metrics(s, d)
    return r.select("query_id", "hit_at_5", *[F.round(c, 6).alias(c) for c in ("mrr_at_10", "ndcg_at_10", "recall_at_50", "duplicate_rate_at_10")], "forbidden_hits_at_10")


@query
def eval_by_group(s, d):
    return evaluate.metric_means(_metrics(s, d))


@query
def latency_percentiles(s, d):
    return evaluate.nearest_rank(table(s, d, "events"), "event_type", "value")


@query
def event_windows(s, d):
    return windowed_counts(table(s, d, "events").where("ts IS NOT NULL")).withColumn("total", F.round("total", 4))


@query
def preview_roll(s, d):
    v = lambda k: F.col("embedding")[k].cast("double")
    return table(s, d, "embeddings").select("vec_id", roll_degrees(v(0), v(1), v(2)).alias("roll"))


@query
def page_audit(s, d):
    # files whose bytes follow from the object id: none, nothing, another format, or an image of one of two widths
    h = _some_number(F.col("object_id"))
    head = F.concat(F.lit(bytearray(b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0")), F.when(h % 2 == 0, F.lit(bytearray(b"\x7f\x02\0"))).otherwise(F.lit(bytearray(b"\x3f\x01\0"))), F.lit(bytearray(b"\xdf\x01\0")))
    content = F.when(h % 5 == 0, F.lit(None).cast("binary")).when(h % 5 == 1, F.lit(bytearray())).when(h % 5 == 2, F.lit(bytearray(b"\x89PNG" + b"0" * 40))).otherwise(head)
    rows = _entry(s, d).select("object_id", content.alias("content")).withColumn("size", audit.webp_size(F.col("content")))
    issue = audit.cascade((audit.quick_issue(F.col("content")).isNotNull(), ""), (F.col("size.width") != 640, "wrong_dimensions"), (F.col("size.height") != 480, "wrong_dimensions"))
    return audit.issue_counts(rows.withColumn("issue", F.when(issue == "", audit.quick_issue(F.col("content"))).otherwise(issue)))


@query
def shard_assign(s, d):
    return audit.shard(table(s, d, "motion_index").select("dataset", "motion_id", "record_id"), ["dataset", "motion_id", "record_id"], 2, 7).select("record_id")


@query
def union_builders(s, d):
    # one builder a dataset, each with the rules of its own, and all their records as one bag
    rows = table(s, d, "motion_index").select(F.lower(F.trim("dataset")).alias("dataset"), "motion_id", "source_motion", "captions", "record_id")
    made = [index_records(rows.where(F.col("dataset") == name).withColumn("path", F.coalesce("source_motion", F.lit(""))).withColumn("stem", F.coalesce("motion_id", F.lit(""))), name) for name in ("interhuman", "interx", "motionxpp", "motionlab")]
    return reduce(DataFrame.unionByName, made).select("dataset", "motion_id", "object_id", "description")


@query
def set_difference(s, d):
    # objects with caption vectors that have no classification
    return table(s, d, "semantic_index").where("object_id IS NOT NULL").select("object_id").subtract(_force(s, d).where("classification IS NOT NULL").select("object_id"))


@query
def set_intersection(s, d):
    return table(s, d, "semantic_index").where("object_id IS NOT NULL").select("object_id").intersect(_entry(s, d).where("dataset = 'interx'").select("object_id"))


@query
def alias_sets(s, d):
    a = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return _nodes(s, d).select("id", F.array_join(F.array_sort(F.array_union(a("aliases_en"), a("aliases_zh"))), "|").alias("aliases"))


@query
def label_fallthrough(s, d):
    c = F.col("classification")
    label = lambda k: F.coalesce(c["taxonomy_labels"][k], c["taxonomy"][k])
    return _force(s, d).where(c.isNotNull()).select("object_id", label("action_category").alias("label"), label("action_tag").alias("tag_label"))


@query
def serialize_entries(s, d):
    name = F.regexp_extract("motion_id", "([^/]+)$", 1)
    return _entry(s, d).select("object_id", F.concat(F.lit("/api/v1/models/"), "object_id").alias("rest_download_path"), F.concat(F.when(name != "", name).otherwise(F.col("object_id")), F.lit(".glb")).alias("filename"), F.concat(F.lit("/api/v1/previews/"), "object_id", F.lit(".webp")).alias("preview_path"))


@query
def tag_texts(s, d):
    v = lambda c: F.coalesce(c, F.lit(""))
    said = F.concat_ws(" ", "dataset", "motion_id", "description")
    return table(s, d, "motion_index").select("record_id", F.array_join(X.taxonomy_tokens(said), "|").alias("tokens"), X.series_key(v("dataset"), v("motion_id")).alias("series_key"), X.stem_description(v("motion_id")).alias("readable"))


@query
def search_page(s, d):
    return search(_index(s, d), Request("a dancer catches a soft ball", top_k=20, mode="lexical"))[0].withColumn("score", F.round("score", 6))


@query
def search_hybrid_page(s, d):
    rows = table(s, d, "semantic_index")
    stored = [list(r.embedding) for r in rows.where("vec_id IN (202, 303) AND embedding IS NOT NULL").orderBy("vec_id").select("embedding").collect()]
    encode = lambda texts: [stored[k % len(stored)] for k in range(len(texts))]
    return search(_index(s, d), Request("push a stiff door open, then sits quietly", top_k=20), captions=rows, encode=encode)[0].withColumn("score", F.round("score", 6))


def _browse(s, d):
    return browse(_library(s, d), _nodes(s, d), Browse(LIB_FILTERS, sort="motion_id", offset=20, limit=20))


@query
def library_page(s, d):
    return _browse(s, d)["page"].select("object_id", "dataset", "motion_id", "frame_count")


@query
def library_total(s, d):
    return _browse(s, d)["total"]


def queries() -> dict[str, Query]:
    return dict(_all)
