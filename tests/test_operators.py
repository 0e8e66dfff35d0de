"""Greedy, random and tree operators against plain Python; filters, audits and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitloom.functions.lexicon import query_tokens
from gaitloom.operators import audit, classify, encode, entries as E, evaluate, facets, hierarchy as H, postings as P, ranking as R, respond, semantic
from gaitloom.plans import library, search

INDEX = "record_id bigint, dataset string, motion_id string, source_motion string, captions array<string>, description string, object_id string, cache_glb string, frame_count int"
NODE = "id string, parent_id string, kind string, zh_cn string, en string, aliases_en array<string>, aliases_zh array<string>, summary string, focus string, source_refs array<string>, legacy_category string, legacy_tag string, asset_taxonomy boolean, legacy_only boolean, allow_depth boolean, priority int"


def index(spark, rows):
    return spark.createDataFrame(rows, INDEX)


def node(i, parent, kind, zh, en, aliases=(), priority=40, **more):
    row = dict(id=i, parent_id=parent, kind=kind, zh_cn=zh, en=en, aliases_en=list(aliases), aliases_zh=[zh], summary=None, focus=None, source_refs=["s"], legacy_category="sports", legacy_tag="other", asset_taxonomy=True, legacy_only=False, allow_depth=False, priority=priority)
    return tuple((row | more).values())


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        node("m1", None, "major", "大类", "Moves", priority=10), node("g1", "m1", "tag_group", "组", "Walks", priority=20), node("a1", "g1", "action", "走路动作", "Hall Walk", ["walk down the hall"]),
        node("a2", "g1", "action", "慢走", "Walk"), node("m2", None, "major", "别类", "Objects"), node("a3", "m2", "action", "举箱", "Crate Lift", ["lift a crate"], priority=60), node("x1", "m2", "action", "旧", "Old", legacy_only=True),
    ]
    return spark.createDataFrame(rows, NODE)


@pytest.fixture(scope="module")
def assets(spark):
    rows = [
        (1, " MotionXPP ", "set/Hall_Walk_1", "p", ["Caption: a dancer will walk down the hall", "sorry, no", " "], None, "o1", "c.glb", 9),
        (2, "motionxpp", "set/Hall_Walk_2", "p", ["a dancer walks slowly on the floor"], "text", "o2", None, -3),
        (3, "interx", "K1", "p", ["two people lift a crate in the park"], "", "o3", "", None),
        (4, "motionlab", "L1", "p", None, "这位舞者慢走过来", None, "d.txt", 50),
        (5, "motionxpp", "set/Hall_Walk_9", "p", ["late line"], "later", "o1", "c.glb", 11),
        (6, None, "N", "p", ["dropped"], "x", "o6", None, 1), (7, "interx", " ", "p", ["dropped"], "x", "o7", None, 1),
    ]
    return E.entries(index(spark, rows))


def test_entries(assets):
    got = {r.motion_id: r for r in assets.collect()}
    assert set(got) == {"set/Hall_Walk_9", "set/Hall_Walk_2", "K1", "L1"}
    assert got["set/Hall_Walk_9"].frame_count == 11 and got["set/Hall_Walk_2"].frame_count is None and got["K1"].description.startswith("two people")
    assert len(got["L1"].object_id) == 64 and got["L1"].captions == [] and got["set/Hall_Walk_2"].source_title == "Hall Walk" and got["K1"].series_key == ""


def test_entries_of_nothing(spark):
    nothing = index(spark, [])
    assert E.entries(nothing).count() == 0 and E.caption_rows(nothing).count() == 0 and P.postings(E.entries(nothing)).count() == 0
    assert R.lexical_scores(E.entries(nothing), R.query_table(spark, [("q", "walk")])).count() == 0


def test_caption_rows(spark):
    rows = [(1, "motionxpp", "a/Walk_1", "p", ["x", "Caption: y", "y", None, "sorry, no", "x"], "d", "o1", None, 1), (2, "interx", "k", "p", [], "only this", "o2", None, 1), (3, "interx", "k", "p", ["z"], "d", None, None, 1)]
    got = sorted((r.object_id, r.caption, r.caption_rank) for r in E.caption_rows(index(spark, rows)).collect())
    assert got == [("o1", "Walk", -1), ("o1", "x", 0), ("o1", "y", 1), ("o2", "only this", 0)]


def test_queries_without_tokens_are_refused(spark, assets):
    with pytest.raises(R.EmptyQuery):
        R.query_table(spark, [("q", "the and !")])
    with pytest.raises(search.BadRequest):
        search.search(assets, search.Request("walk", mode="psychic"))


def greedy(rows):
    low, high = min(r["score"] for r in rows), max(r["score"] for r in rows)
    scale, chosen, rest = max(high - low, 1e-6), [], list(rows)

    def alike(a, b):
        if a["series_key"] and a["series_key"] == b["series_key"]:
            return 1.0
        x, y = (set(query_tokens(r["source_title"] or r["description"])) for r in (a, b))
        return len(x & y) / len(x | y) if x | y else 0.0

    while rest:
        best = max(rest, key=lambda r: ((r["score"] - low) / scale - min(0.75, 0.15 * sum(alike(r, c) for c in chosen)), r["score"], r["motion_id"]))
        chosen.append(best)
        rest.remove(best)
    return [r["object_id"] for r in chosen]


def test_diversify_is_the_greedy_order(spark):
    rng = random.Random(2)
    words = "walk run jump kick dance crate floor wave bow turn".split()
    rows = []
    for q in range(6):
        for k in range(rng.randrange(1, 20)):
            rows.append({"query_id": f"q{q}", "object_id": f"o{k}", "score": rng.choice([1.0, 2.0, round(rng.random() * 5, 3)]), "motion_id": f"m{rng.randrange(30)}-{k}", "series_key": rng.choice(["", "", "s1", "s2"]), "source_title": rng.choice(["", "Hall Walk"]), "description": " ".join(rng.sample(words, 3))})
    got = {}
    for r in R.diversify(spark.createDataFrame(rows)).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.object_id)
    assert got == {q: greedy([r for r in rows if r["query_id"] == q]) for q in got} and len(got) == 6


def test_rerank(spark):
    rows = [("q", "a walk", 0.5, "Walk Far", "walk far away", ["walk"], "m1", "o1"), ("q", "a walk", 3.0, "", "sit down", ["walk a bit"], "m2", "o2"), ("q", "a walk", 0.1, "A Walk", "nothing", [], "x", "o3")]
    df = spark.createDataFrame(rows, "query_id string, query string, base_score double, source_title string, description string, captions array<string>, motion_id string, object_id string")
    got = {r.object_id: r for r in R.rerank(df).collect()}
    assert got["o3"].exact_source_match and got["o3"].reranker_score > 100 and got["o2"].title_score is None
    assert abs(got["o1"].reranker_score - (2.0 + 0.005)) < 1e-9 and abs(got["o2"].reranker_score - (2.0 + 0.01)) < 1e-9


def test_sampling(spark):
    rows = [("q", f"o{k}", 5.0 - k, k + 1) for k in range(5)]
    df = spark.createDataFrame(rows, "query_id string, object_id string, score double, rank int")
    assert [r.object_id for r in R.sample(df, 3, 0, "s").orderBy("place").collect()] == ["o0", "o1", "o2"]
    once = R.sample(df, 3, 0.5, "s").orderBy("place").collect()
    assert [r.object_id for r in R.sample(df.repartition(5), 3, 0.5, "s").orderBy("place").collect()] == [r.object_id for r in once]
    flat = df.withColumn("score", -F.col("score"))
    assert [r.object_id for r in R.sample(flat, 2, 0.5, "s").orderBy("place").collect()] == ["o0", "o1"]
    many = spark.range(4000).select(F.concat(F.lit("q"), "id").alias("query_id")).crossJoin(df.drop("query_id"))
    first = {r.object_id: r.n / 4000 for r in R.sample(many, 1, 0.4, "z").groupBy("object_id").agg(F.count("*").alias("n")).collect()}
    weights = np.exp((np.array([5.0, 4, 3, 2, 1]) - 5) / 2)
    assert all(abs(first.get(f"o{k}", 0) - w) < 0.04 for k, w in enumerate(weights / weights.sum()))


def test_hierarchy(spark, nodes):
    up = H.closure(nodes)
    assert {tuple(r) for r in up.where("node_id = 'a1'").collect()} == {("a1", "a1", 0), ("a1", "g1", 1), ("a1", "m1", 2)}
    assert {r.node_id for r in H.descendants(up, "g1").collect()} == {"g1", "a1", "a2"}
    assert {r.node_id: r.path for r in H.paths(up, nodes).collect()}["a1"] == ["大类", "组", "走路动作"]
    assert {r.node_id for r in H.text_filter(nodes, up, "hall").collect()} == {"a1", "g1", "m1"} and {r.node_id for r in H.text_filter(nodes, up, "objects").collect()} == {"m2"}
    assert {r.id for r in H.visible(nodes, leaves_only=True).collect()} == {"a1", "a2", "a3"}
    bad = nodes.union(spark.createDataFrame([node("b1", "gone", "action", "b", "B", source_refs=[]), node("a2", "g1", "action", "c", "C"), node("deep", "a1", "action", "d", "D")], NODE))
    problems = {(r.id, r.problem) for r in H.lint(bad, H.closure(bad)).collect()}
    assert problems == {("b1", "missing parent"), ("b1", "missing sources"), ("a2", "duplicate"), ("deep", "too deep")}
    moved = H.alias_transfer(nodes, spark.createDataFrame([("a2", "举箱"), ("a1", "举箱")], "legacy_id string, target_label string")).collect()
    assert [tuple(r) for r in moved] == [("a3", ["lift a crate", "walk down the hall"])]
    flat = H.flatten_catalog(spark.createDataFrame([("体", "s", [("组", "f", ["走", "跑"])])], "major string, summary string, groups array<struct<name: string, focus: string, tags: array<string>>>")).collect()
    import hashlib

    assert {r.id for r in flat if r.kind == "action"} == {"asset_tag_" + hashlib.sha1("\x1f".join(["体", "组", t]).encode()).hexdigest()[:12] for t in "走跑"}
    grown = library.tree([r.asDict() for r in nodes.collect()], {"m1": 3}, {"a1": 1})
    assert [n["id"] for n in grown] == ["m1", "m2"] and grown[0]["count"] == 3 and [t["id"] for t in grown[1]["tags"]] == ["a3"]


def test_a_cycle_is_an_error(spark):
    rows = [node("a", "b", "action", "a", "A"), node("b", "a", "action", "b", "B")]
    with pytest.raises(Exception, match="RECURSION"):
        H.closure(spark.createDataFrame(rows, NODE)).collect()


def test_legacy_axes_by_prefix(spark):
    rows = [node("weapon_sword", None, "major", "a", "A"), node("drive_car", None, "major", "b", "B"), node("medicalx", None, "major", "c", "C"), node("free", None, "major", "d", "D")]
    n = spark.createDataFrame(rows, NODE)
    got = {r.node_id: (r.category, r.tag, r.domain) for r in H.legacy_axes(n, H.closure(n)).collect()}
    assert got == {"weapon_sword": ("military_combat", "weapons_use", "conflict"), "drive_car": ("daily_life_labor", "transportation_travel", "commute_locomotion"), "medicalx": ("professional_skills", "medical_care", "assist_care"), "free": ("sports", "other", "sport_fitness")}


def test_rule_classification(assets, nodes):
    got = {r.motion_id: r for r in classify.rule_classification(assets, nodes).join(assets.select("object_id", "motion_id"), "object_id").collect()}
    assert got["set/Hall_Walk_2"].node_ids and got["K1"].primary_action_node_id == "a3" and got["K1"].space == "outdoor" and got["K1"].participants == "pair"
    assert got["L1"].primary_action_node_id == "a2" and got["set/Hall_Walk_2"].space == "indoor" and got["K1"].classification_confidence == 0.69


def test_specific_is_greedy(spark):
    rng = random.Random(4)
    rows = [node(f"n{k}", f"n{rng.randrange(k)}" if k and rng.random() < 0.7 else None, "action", str(k), str(k), priority=rng.choice([20, 40, 60])) for k in range(25)]
    parent, priority = {r[0]: r[1] for r in rows}, {r[0]: r[15] for r in rows}

    def kin(i):
        out = []
        while i:
            out.append(i)
            i = parent[i]
        return out

    matches, want = [], {}
    for o in range(20):
        own = {f"n{rng.randrange(25)}": rng.randrange(1, 4) for _ in range(12)}
        matches += [(f"o{o}", n, ["p"], length) for n, length in own.items()]
        chosen = []
        for n in sorted(own, key=lambda n: (-priority[n], -own[n], n)):
            if not any(n in kin(c) or c in kin(n) for c in chosen):
                chosen.append(n)
        want[f"o{o}"] = chosen[:8]
    n = spark.createDataFrame(rows, NODE)
    got = classify.specific(spark.createDataFrame(matches, "object_id string, node_id string, matched array<string>, length int"), n).collect()
    assert {r.object_id: [x.node_id for x in r.selected] for r in got} == want


def test_facets_properties(spark, tiny):
    from gaitloom import queries

    rows = queries._library(spark, tiny).cache()
    n = rows.count()
    free = facets.facet_counts(rows, {}).where("facet = 'dataset'").agg(F.sum("n")).first()[0]
    assert free == n
    one = {(r.facet, r.value): r.n for r in facets.facet_counts(rows, {"dataset": "motionxpp"}).collect()}
    two = {(r.facet, r.value): r.n for r in facets.facet_counts(rows, {"dataset": "motionxpp", "space": "indoor"}).collect()}
    assert set(one) == set(two) and all(two[k] <= one[k] for k in one if k[0] != "space")
    assert all(one[("action_node", v)] >= c for (f, v), c in one.items() if f == "action_node_direct")
    with pytest.raises(ValueError):
        facets.predicates({"colour": "red"})


def test_browse_and_search(spark, tiny):
    from gaitloom import queries

    rows, nodes = queries._library(spark, tiny), queries._nodes(spark, tiny)
    out = library.browse(rows, nodes, library.Browse({"dataset": "interx"}, limit=7, include_facets=False))
    assert out["facets"] is None and out["page"].count() == min(7, out["total"].first().total)
    with pytest.raises(library.UnknownNode):
        library.browse(rows, nodes, library.Browse({"action_node": "nope"}))
    entry = P.indexed(queries._entry(spark, tiny))
    page, warned = search.search(entry, search.Request("深深鞠躬", mode="hybrid"))
    assert len(warned) == 2 and page.count() <= 5
    ranked = [r.position for r in search.search(entry, search.Request("walks", top_k=9, mode="lexical"))[0].orderBy("position").collect()]
    assert ranked == list(range(1, len(ranked) + 1))


def test_nearest_rank(spark):
    rows = [("a", float(v)) for v in (5, 1, 2, 2, 9)] + [("b", 7.0), ("b", None)]
    got = {r.k: (r.p50, r.p95) for r in evaluate.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": (2.0, 9.0), "b": (7.0, 7.0)}


def test_audit(spark):
    usable = b"RIFFxxxxWEBPxxxx"
    rows = [(1, None), (2, b""), (3, usable), (4, b"x" * 20)]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, c binary").select("i", audit.quick_issue(F.col("c")).alias("x")).collect()}
    assert got == {1: "missing", 2: "empty", 3: None, 4: "invalid_format"}
    decoded = [(None, None, None, None, None, None, None), (0, True, "WEBP", 1, 1, 99, 0.9), (9, False, None, None, None, None, None), (9, True, "PNG", 4, 4, 99, 0.9), (9, True, "WEBP", 5, 4, 99, 0.9), (9, True, "WEBP", 4, 4, 3, 0.9), (9, True, "WEBP", 4, 4, 99, 0.9)]
    df = audit.preview_issue(spark.createDataFrame(decoded, "length int, readable boolean, format string, width int, height int, channel_range int, foreground_ratio double"), 4, 4)
    assert [r.issue for r in df.collect()] == ["missing", "empty", "corrupt", "invalid_format", "wrong_dimensions", "blank", None]
    assert {r.issue: r.n for r in audit.issue_counts(df).collect()}["ok"] == 1 and audit.issue_samples(df, ["issue"], 3).count() == 3
    ids = spark.range(100).select(F.col("id").alias("k"))
    parts = [sorted(r.k for r in audit.shard(ids.repartition(5), ["k"], i, 3).collect()) for i in range(3)]
    assert parts == [list(range(i, 100, 3)) for i in range(3)]


def test_phrases_of_any_length(spark, assets):
    long = "a dancer walks slowly on the floor and then turns around twice"
    rows = [node("n1", None, "action", "长", long, [long]), node("n2", None, "action", "短", "floor")]
    listed = classify.phrases(spark.createDataFrame(rows, NODE)).collect()
    assert max(len(r.phrase) for r in listed) == 12
    row = E.entries(index(spark, [(1, "interx", "k", "p", [f"here {long} again"], "d", "o", None, 1)]))
    assert {r.node_id: r.length for r in classify.phrase_matches(row, spark.createDataFrame(rows, NODE)).collect()} == {"n1": 12, "n2": 1}


def test_published_index_is_pruned_and_kept(spark, tmp_path):
    rows = [(k, "motionlab", f"m{k}", "p", [f"a dancer walks word{k}"], "d", f"o{k}", None, 1) for k in range(50)]
    entry, root = E.entries(index(spark, rows)), str(tmp_path / "ix")
    built = []
    held = P.publish_index(spark, root, "f1", lambda: built.append(1) or entry)
    again = P.publish_index(spark, root, "f1", lambda: built.append(1) or entry)
    assert built == [1] and again.documents == 50 and again.mean_length == held.mean_length
    plan = again.hits(["word7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "token" in plan.split("PushedFilters: ")[1].split("]")[0] and all(P.bucket_of(t) == b for t, b in again.postings.select("token", "bucket").distinct().collect())
    asked = R.query_table(spark, [("q", "walks word7")])
    one, two = ({(r.object_id, r.score) for r in R.lexical_scores(x, asked).collect()} for x in (entry, again))
    assert one == two and len(one) == 50
    few = R.lexical_scores(again, asked, limit=3).collect()
    assert len(few) == 3 and "o7" in {r.object_id for r in few} and R.candidate_limit(5) == 1000 and R.candidate_limit(200) == 1600
    assert P.publish_index(spark, root, "f2", lambda: built.append(1) or entry).documents == 50 and built == [1, 1]


def test_dense_scores_keep_the_best_of_a_batch(spark):
    rows = [(k, f"o{k}", [float(k % 7), 1.0]) for k in range(200)] + [(900, "x", None), (901, "y", [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, object_id string, embedding array<float>")
    order = [F.desc(F.round("score", 9)), F.asc("vec_id")]
    vectors = {"a": [[1.0, 0.0]], "b": [[0.0, 1.0], [1.0, 1.0]]}
    every = {tuple(r) for r in R.top(R.dense_scores(df, vectors), 9, order).collect()}
    kept = R.dense_scores(df, vectors, keep=9)
    assert every == {tuple(r) for r in R.top(kept, 9, order).collect()} and kept.count() < 400


def test_nearest_rank_of_a_large_group(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=30_000), 3)
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    got = evaluate.nearest_rank(df, "k", "v", accuracy=1000).first()
    ordered = np.sort(values)
    assert (got.p50, got.p95) == tuple(ordered[int(np.round((len(values) - 1) * p))] for p in (0.5, 0.95))


def test_semantic_result(spark, assets, nodes):
    hits = [("o1", 1, "a1", 0.9, 0.8, 0.7, 0.6, 1), ("o1", 2, "a3", 0.4, 0.3, 0.2, 0.1, 2), ("o2", 1, "a3", 0.5, 0.5, 0.5, 0.5, 3), ("o2", 2, "a2", 0.5, 0.4, 0.4, 0.4, 3), ("o3", 1, "a1", 0.2, 0.1, 0.1, 0.1, 4)]
    df = spark.createDataFrame(hits, "object_id string, rank int, node_id string, score double, leaf_score double, group_score double, major_score double, matched_vec bigint")
    rules = semantic.rule_records(assets, nodes, "v1")
    told = {r.object_id: r.classification for r in rules.collect()}
    assert told["o2"].action_nodes[0].role == "primary" and told["o2"].action_nodes[0].path[0] == "大类" and told["o3"].matched_keywords["space"] == ["park"] and told["o3"].taxonomy["participants"] == "pair"
    chosen = {r.object_id: r for r in semantic.scored_candidates(df, rules, "a").collect()}
    assert set(chosen) == {"o1", "o2"} and chosen["o1"].margin == 0.5 and chosen["o2"].margin == 0.0 and chosen["o2"].rule_conflict and chosen["o2"].expected == ["a1", "a2"]
    levels = classify.confidence_levels(semantic.scored_candidates(df, rules, "a"))
    captions = spark.createDataFrame([(1, "walks"), (3, None)], "vec_id bigint, caption string")
    made = {r.object_id: r.classification for r in semantic.apply_semantic(levels, rules, nodes, captions, model="m", version="v2", prefix="a").collect()}
    one = made["o1"]
    assert one.primary_action_node_id == "a1" and one.classification_model.margin == 0.5 and one.classification_model.candidate_node_ids == ["a1", "a3"] and one.classification_model.matched_caption == "walks"
    assert one.classification_model.status.endswith("_confidence") and one.classification_confidence == 0.9 and one.taxonomy["participants"] == "single" and made["o3"].classification_method is None
    other = {r.object_id: r.classification for r in semantic.apply_semantic(levels, rules, nodes, captions, model="m", version="v2").collect()}
    assert all(c.classification_model is None for c in other.values())
    stored = rules.where("object_id = 'o3'").withColumn("classification", F.col("classification").withField("taxonomy_version", F.lit("v9")).withField("taxonomy", F.create_map(F.lit("participants"), F.lit("single"))))
    kept = {r.object_id: r for r in semantic.reused(assets, stored, rules, "v9").collect()}
    assert kept["o3"].cached and kept["o3"].classification.taxonomy == {"participants": "pair"} and not kept["o1"].cached and kept["o1"].classification.taxonomy_version == "v1"
    measures = {r.measure: r.value for r in semantic.summary(assets.select("object_id").join(rules, "object_id", "left"), H.visible(nodes, leaves_only=True)).collect()}
    assert measures["entry_count"] == 4 and measures["leaf_label_count"] == 3
    counted = semantic.ordered_counts(semantic.node_counts(rules)).where("dimension = 'tag'").orderBy("place").collect()
    assert [r.place for r in counted] == list(range(1, len(counted) + 1)) and all(a.n >= b.n for a, b in zip(counted, counted[1:]))


def test_contract():
    both = dict(semantic.CONTRACT, model_config_sha256="x")
    semantic.check_contract(both | {"encoding_role": "document", "label_count": 3, "dimension": 4}, both, 3, 9, 4)
    for labels, captions in ((both, both), (both | {"encoding_role": "document", "pooling": "mean"}, both), (both | {"encoding_role": "document"}, both | {"model_config_sha256": "y"}), (both | {"encoding_role": "document", "dimension": 5}, both)):
        with pytest.raises(semantic.ContractError):
            semantic.check_contract(labels, captions, 3, 9, 4)


def test_projections_and_readers(spark, assets):
    full = respond.full(respond.lookup(assets, ["o1", "nobody"]), "http://h/").collect()
    assert len(full) == 1 and full[0]._links.self == "http://h/api/v1/entries/o1" and full[0].model.filename == "Hall_Walk_9.glb" and not full[0].preview.available and full[0].thumbnail.download_url is None
    assert respond.lookup(assets, []).count() == 0 and respond.lookup(assets, [f"o{k}" for k in range(300)]).count() == 3
    compact = {r.object_id: r for r in respond.compact(assets.withColumn("score", F.lit(2.0)).withColumn("best", F.lit(4.0)), best="best").collect()}
    assert compact["o3"].pooled_score == 0.5 and compact["o3"].model.rest_download_path == "/api/v1/models/o3" and "model" not in respond.compact(assets, model=False).columns
    items = respond.search_items(assets.withColumn("rank", F.lit(1)).withColumn("score", F.lit(1.0)).withColumn("best", F.lit(0.0)).withColumn("preview_path", F.lit("p")).withColumn("canonical", F.lit(False)).withColumn("rotation", F.lit(12.5)), "http://h", "best").collect()
    assert all(r.pooled_score == 0 and r.preview.available and r.preview.rotation_degrees == 12.5 and r.glb.content_type == "model/gltf-binary" for r in items)
    bodies = [("a", '{"items": [{"object_id": "x", "glb": {"url": "/g/x"}}]}'), ("b", '{"results": [{"object_id": "y", "model": {"download_path": "m/y"}}]}'), ("c", '{"data": [{"object_id": "z", "_links": {"download": "https://e/z"}}, {"object_id": "n"}]}')]
    rows = respond.response_items(spark.createDataFrame(bodies, "run string, body string")).select("run", "object_id", respond.download_url("http://b/").alias("u")).collect()
    assert {(r.run, r.object_id, r.u) for r in rows} == {("a", "x", "http://b/g/x"), ("b", "y", "http://b/m/y"), ("c", "z", "https://e/z"), ("c", "n", None)}
    with pytest.raises(Exception, match="items, results or data"):
        respond.response_items(spark.createDataFrame([("d", "{}")], "run string, body string")).collect()
    said = spark.createDataFrame([("/a/b/c",), ("/x/c",)], "p string").select(respond.relative(F.col("p"), "/a/b").alias("r")).collect()
    assert [r.r for r in said] == ["c", "/x/c"]


def test_models_over_tables(spark):
    def load_encoder():
        return lambda texts: np.array([[len(t), t.count("a") + 1.0] for t in texts])

    def load_scorer():
        return lambda pairs: [float(len(a) + 10 * len(b)) for a, b in pairs]

    hidden = np.arange(2 * 4 * 3, dtype=float).reshape(2, 4, 3)
    right, left = np.array([[1, 1, 1, 0], [1, 1, 0, 0]]), np.array([[0, 1, 1, 1], [0, 0, 1, 1]])
    assert (encode.last_token_pool(hidden, right) == hidden[[0, 1], [2, 1]]).all() and (encode.last_token_pool(hidden, left) == hidden[:, 3]).all()
    assert np.allclose(np.linalg.norm(encode.l2_normalized([[3.0, 4.0], [0.0, 0.0]]), axis=1), [1, 0])
    rows = [(1, "abc", "x"), (2, " abc ", None), (3, "", "aa"), (4, None, "aa")]
    got = encode.encode_texts(spark.createDataFrame(rows, "k int, t string, u string"), ["t", "u"], load_encoder, batch=2).orderBy("k").collect()
    assert got[0].t_embedding == got[1].t_embedding and np.isclose(np.linalg.norm(got[0].t_embedding), 1) and got[2].t_embedding is None and got[3].t_embedding is None and got[1].u_embedding is None
    pairs = [("Walk  on", "x", 1), ("walk on", "X", 2), ("walk on", None, 3)] + [("a", "b", k) for k in range(4, 50)]
    scored = {r.k: r.pair_score for r in encode.score_pairs(spark.createDataFrame(pairs, "query string, document string, k int"), load_scorer).collect()}
    assert scored[1] == scored[2] == 17.0 and scored[3] is None and scored[49] == 11.0 and len(scored) == 49


def test_previews(spark, assets):
    files = spark.createDataFrame([("file:/r/motionxpp/set/Hall_Walk_9.webp", 90), ("/r/interx/K1.png", 90), ("/r/motionlab/L1.webp", 3)], "path string, length bigint")
    got = {r.motion_id: r.preview_path for r in audit.resolve_previews(assets, files, "/r/").collect()}
    assert got == {"set/Hall_Walk_9": "/r/motionxpp/set/Hall_Walk_9.webp", "K1": "/r/interx/K1.png", "L1": None, "set/Hall_Walk_2": None}
    assert {r.motion_id for r in audit.preview_candidates(assets, files, "/r").collect()} == {"K1", "L1", "set/Hall_Walk_2"}
    assert {r.motion_id for r in audit.preview_candidates(assets, files, "/r", dataset="interx", overwrite=True).collect()} == {"K1"} and audit.preview_candidates(assets, files, "/r", ids=["o1"]).count() == 0
    shards = [{r.motion_id for r in audit.preview_candidates(assets, files, "/r", index=i, count=2, overwrite=True).collect()} for i in range(2)]
    assert len(shards[0] | shards[1]) == 4 and not shards[0] & shards[1]
    head = lambda kind, rest: bytearray(b"RIFF\0\0\0\0WEBP" + kind + b"\x0a\0\0\0" + rest + b"\0" * 20)
    images = [head(b"VP8X", b"\0\0\0\0\x7f\x02\0\xdf\x01\0"), head(b"VP8 ", b"\0\0\0\x9d\x01\x2a\x80\x02\xe0\x01"), head(b"VP8L", b"\x2f" + ((639) | (479 << 14)).to_bytes(4, "little")), bytearray(b"junk"), None]
    sizes = [tuple(r.s) if r.s else None for r in spark.createDataFrame([(k, b) for k, b in enumerate(images)], "k int, c binary").select("k", audit.webp_size(F.col("c")).alias("s")).orderBy("k").collect()]
    assert sizes == [(640, 480)] * 3 + [None, None]
    tally = audit.migration_tally(spark.createDataFrame([("a", 1, 1, None), ("b", 1, 0, None), ("c", 0, 0, "broken")], "path string, converted int, removed int, error string")).first()
    assert tuple(tally) == (2, 1, 1)
