"""Problems 1 and 3: copies, near-duplicates; against brute force on small fixtures."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaitloom.llm import copies, near

SCHEMA = "record_id bigint, captions array<string>, description string, content string, fp_high int, class string, words array<int>"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", [1]) for r in rows], SCHEMA)


def test_forms_of_one_text_are_one_value():
    same = ["A person walks.", "a PERSON  walks", "A_person_walks!", "Ａ person walks", "“A person — walks”"]
    assert len({str(copies.caption_parts(x)) for x in same}) == 1
    assert copies.letters("Trömaind") == copies.letters("Trömaind") != copies.letters("Tromaind")
    assert copies.letters("straße") == copies.letters("STRASSE")


NAMES = frozenset(("action", "mood", "tempo", "side", "prop", "level"))


def test_parts_may_stand_in_any_order_whatever_their_signs():
    form = lambda c: copies.caption_parts(c, NAMES)
    a = form("Action: pivot step; Mood: weary; Tempo: fast")
    for b in ("Tempo = fast | Action = pivot step | Mood = weary", "mood - weary / tempo - fast / action - pivot_step", "Tempo   fast ， Mood  weary Action  pivot step", "“Action\t pivot step |\tMood\t_ weary | Tempo _ fast", "Mood:\n weary | Tempo:\n fast | Action:\n pivot step", "Mood: weary\nAction: pivot step\nTempo: fast", "Action:pivot step Mood:weary Tempo:fast", "- mood_-_weary,_tempo_-_fast,_action_-_pivot_step"):
        assert sorted(form(b)) == sorted(a), b
    assert form("Colour: red; Size of shoe: tall") == ["colour\x1fred", "sizeofshoe\x1ftall"]
    assert form("Next to prop Dov, the actor turns; with one hand") == ["nexttopropdovtheactorturnswithonehand"]


def test_words_that_are_no_parts_keep_their_order(spark):
    form = lambda c: copies.caption_parts(c, NAMES)
    assert form("Side step with prop and level walk") != form("prop and level walk side step with")
    assert sorted(form("side: view; mood: calm")) != sorted(form("view: side; mood: calm"))
    assert form("The actor says: up, then goes down") == ["theactorsaysupthengoesdown"]
    rows = [(1, ["Side step with prop and level walk"], "d"), (2, ["prop and level walk side step with"], "d"), (3, ["side: view; mood: calm"], "d"), (4, ["view: side; mood: calm"], "d"), (5, ["Mood  calm side _ view"], "d")]
    assert [tuple(r) for r in copies.copies(table(spark, rows)).collect()] == []
    rows += [(6, ["mood: calm; side: view; prop: hat"], "e"), (7, ["Mood = free; Side = none"], "f")]
    assert [tuple(r) for r in copies.copies(table(spark, rows)).collect()] == [(3, 5)]
    assert copies.learned_names(table(spark, rows)) == {"mood", "side"} and copies.learned_names(table(spark, [])) == frozenset()


def test_fingerprint_is_a_multiset(spark):
    c = lambda *x, d="d": copies.record_content(list(x), d)
    assert copies.fingerprint(c("a b", "c")) == copies.fingerprint(c("C!", "A  b", " "))
    assert copies.fingerprint(c("a", "a")) != copies.fingerprint(c("a"))
    assert copies.fingerprint(c("a", d="b")) != copies.fingerprint(c("b", d="a"))
    assert copies.same(c("a", "b"), c("b", "A")) and not copies.same(c("a", "a", "b"), c("a", "b", "b"))


def test_copies_edge_cases(spark):
    rows = [
        (5, ["A b", "c"], "x"), (3, ["c!", None, "", "a B"], "X."), (9, ["C", "A b", " "], "x"),
        (1, None, None), (2, ["..."], "  "), (4, [], ""), (None, ["A b", "c"], "x"),
        (6, None, "only"), (7, [], "ONLY "), (8, ["only"], None), (10, ["a"], "q"), (11, ["a", "a"], "q"),
    ]
    got = sorted(tuple(r) for r in copies.copies(table(spark, rows)).collect())
    assert got == [(3, 5), (3, 9), (6, 7)]
    left = {r.record_id: r.n_copies for r in copies.collapsed(table(spark, rows)).collect()}
    assert left == {3: 3, 1: 1, 2: 1, 4: 1, 6: 2, 8: 1, 10: 1, 11: 1}
    assert copies.copies(table(spark, [])).count() == 0 and copies.collapsed(table(spark, [])).count() == 0


def test_half_of_all_rows_may_be_one_text(spark):
    rows = [(k, ["One and the same"], "d") for k in range(400)] + [(k, [f"text {k}"], "d") for k in range(400, 800)] + [(0, ["One and the same!"], "d"), (7, ["one and the same"], "d")]
    got = copies.copies(table(spark, rows), hot_share=0.01)
    found = got.collect()
    assert len(found) == 400 and {r.keep_id for r in found} == {0} and {r.copy_id for r in found} == set(range(1, 400))
    # the members of the one group are joined under many keys, none of which holds more than a few of them
    sizes = [r.n for r in got.groupBy(F.pmod(F.xxhash64("copy_id"), F.lit(50))).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 40 and max(sizes) < 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=5), st.randoms())
def test_order_and_case_never_matter(captions, rng):
    other = [c for c in captions]
    rng.shuffle(other)
    a, b = copies.record_content(captions, "z"), copies.record_content(other, "Z ")
    assert copies.fingerprint(a) == copies.fingerprint(b) and copies.same(a, b)


def brute_near(rows, least=32, threshold=0.8):
    han = "㐀-䶿一-鿿"
    words = {r[0]: set(re.findall(f"[{han}]|[^\\W_{han}]+", "\n".join(c for c in r[1] or () if c).lower())) for r in rows if r[0] is not None}
    mark = {r[0]: str(sorted(map(sorted, copies.record_content(r[1], r[2])))) for r in rows if r[0] is not None}
    return {(min(a, b), max(a, b)) for a, b in combinations(words, 2) if len(words[a]) >= least <= len(words[b]) and mark[a] != mark[b] and len(words[a] & words[b]) >= threshold * len(words[a] | words[b]) - 1e-9}


def test_near_duplicates_agree_with_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(900)]
    rows = []
    for base in range(40):
        words = rng.sample(vocabulary, 45)
        for _ in range(4):
            own = words[:]
            for _ in range(rng.randrange(9)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rng.shuffle(own)
            rows.append((len(rows), [" ".join(own[:20]), " ".join(own[20:])], f"d{base}"))
    rows += [(900, rows[0][1], "other description"), (901, rows[0][1], rows[0][2]), (902, None, "d"), (903, [None, ""], None), (None, rows[0][1], "n"), (904, ["走" + "好" * 40], "d"), (905, ["".join(chr(0x4E00 + k) for k in range(40))], "d"), (906, ["".join(chr(0x4E00 + k) for k in range(38))], "d")]
    truth = brute_near(rows)
    got = [tuple(r) for r in near.near_duplicates(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) <= truth
    assert len(set(got)) >= 0.97 * len(truth) and len(truth) > 60
    assert (0, 900) in got and (0, 901) not in got and (905, 906) in got


def test_near_duplicates_of_nothing(spark):
    assert near.near_duplicates(table(spark, [])).count() == 0
    assert near.near_duplicates(table(spark, [(1, ["too short"], "d")])).count() == 0


def test_a_crowd_of_copies_is_one_class(spark):
    words = [f"w{k}" for k in range(50)]
    rows = [(k, [" ".join(words)], "d") for k in range(300)] + [(1000, [" ".join(words[:48])], "d")] + [(2000 + k, [" ".join(f"x{k}q{j}" for j in range(40))], "d") for k in range(300)]
    got = {tuple(r) for r in near.near_duplicates(table(spark, rows)).collect()}
    assert got == {(k, 1000) for k in range(300)}


def test_groups_are_the_components_of_the_pairs(spark):
    words = [f"w{k}" for k in range(50)]
    text = " ".join(words)
    rows = [(k, [text], "d") for k in range(300)] + [(1000, [" ".join(words[:48])], "d"), (1001, [" ".join(words[:46])], "e")]
    rows += [(2000, ["A" + text], "x"), (2001, [text.upper().replace(" ", "  ")], "d")]
    rows += [(3000 + k, [" ".join(f"y{j}" for j in range(40))], f"own {k}") for k in range(5)]
    rows += [(4000 + k, [" ".join(f"z{j}" for j in range(40))], "one") for k in range(5)] + [(5000 + k, [" ".join(f"x{k}q{j}" for j in range(40))], "d") for k in range(50)]
    group = {}
    for r in near.near_duplicates(table(spark, rows)).collect():
        a, b = group.setdefault(r.record_a, {r.record_a}), group.setdefault(r.record_b, {r.record_b})
        if a is not b:
            a |= b
            for x in b:
                group[x] = a
    got = [tuple(r) for r in near.groups(table(spark, rows)).collect()]
    assert dict(got) == {x: min(own) for x, own in group.items()} and len(got) == len(group)
    assert {g for x, g in got if 3000 <= x < 3005} == {3000} and not any(4000 <= x for x, _ in got)
    assert near.groups(table(spark, [])).count() == 0


def test_a_class_is_one_row_in_every_band(spark):
    rows = [(k, [" ".join(f"w{j}" for j in range(50)) + " w1" * (k % 40_000)], "d") for k in (0, 1, 2, 3, 39_999)]
    df = table(spark, rows).repartition(3)
    bag = near.bags(df)
    assert bag.select("class").distinct().count() == 1 and near.bags(df, counted=True).select("class").distinct().count() == 5
    total, freq = near.document_frequencies(bag)
    assert total == 5 and near.candidate_classes(bag, total, freq, least_ratio=0.8).count() == 0


def test_repeated_captions_hide_no_pair(spark):
    words = [f"w{k}" for k in range(50)]
    rows = [(1, [" ".join(words)] * 9, "d"), (2, [" ".join([*words[:46], "a", "b", "c"])], "d")]
    assert [tuple(r) for r in near.near_duplicates(table(spark, rows)).collect()] == [(1, 2)]


def test_weighted_form_and_word_rules(spark):
    assert near.words_of("Left-hand ÉCOLE, 第二 x2") == ["left", "hand", "école", "第", "二", "x2"]
    assert near.shingles(list("abcdef"), 5) == ["a b c d e", "b c d e f"]
    words = [f"w{k}" for k in range(60)]
    rows = [(1, [" ".join(words)], "d"), (2, [" ".join([*words[:58], "new"])], "d"), (3, [" ".join(f"z{k}" for k in range(60))], "d")]
    assert {tuple(r) for r in near.near_duplicates(table(spark, rows), measure="weighted").collect()} == {(1, 2)}
    links = near.class_links(table(spark, [*rows, (4, rows[0][1], "d")]), n=5).collect()
    assert [(r.record_a, r.record_b) for r in links] == [(1, 2)] and 0.8 <= links[0].similarity < 1


def test_weighted_form_names_every_pair_of_records(spark, tmp_path):
    from gaitloom.llm import queries

    words, few = [f"w{k}" for k in range(60)], [f"z{k}" for k in range(33)]
    text = " ".join(words)
    rows = [(1, [text], "d"), (2, [text], "another"), (3, [text.upper()], "d"), (4, [" ".join([*words[:58], "new"])], "d")]
    # 33 words are but 29 shingles of five; 31 words are too few however often they stand
    rows += [(5, [" ".join(few)], "d"), (6, [" ".join([*few[:32], "new"])], "d"), (7, [" ".join(few[:31] * 2)], "d"), (8, [" ".join(few[:31] * 2)], "e")]
    table(spark, rows).write.parquet(str(tmp_path / "motion_index.parquet"))
    got = {(r.record_a, r.record_b): r.similarity for r in queries.queries()["p3_weighted"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 2), (2, 3), (1, 4), (2, 4), (3, 4), (5, 6)}
    assert got[1, 2] == got[2, 3] == 1 and 0.8 <= got[1, 4] == got[2, 4] == got[3, 4] < 1 and 0.8 <= got[5, 6] < 1


def test_weights_follow_from_exact_counts(spark, monkeypatch):
    # two buckets for all words: bucketed counts tell rare and common words apart no more
    monkeypatch.setattr(near.document_frequencies, "__defaults__", (1,))
    common = [f"c{k}" for k in range(30)]
    rows = [(k, [" ".join([*common, *(f"own{k}x{j}" for j in range(9))])], f"d{k}") for k in range(60)]
    rows += [(100, [" ".join(f"w{k}" for k in range(50))], "d"), (101, [" ".join([*(f"w{k}" for k in range(45)), *common[:5]])], "d")]
    words = {r[0]: set(r[1][0].split()) for r in rows}
    weight = {w: math.log1p(len(rows) / sum(w in x for x in words.values())) ** 0.5 for w in set().union(*words.values())}
    mass = lambda x: sum(map(weight.get, x))
    truth = {(a, b): mass(words[a] & words[b]) / mass(words[a] | words[b]) for a, b in combinations(words, 2)}
    got = {(r.record_a, r.record_b): r.similarity for r in near.scored_duplicates(table(spark, rows), threshold=0.6, measure="weighted", bands=60, rows=2).collect()}
    assert set(got) == {p for p, s in truth.items() if s >= 0.6} == {(100, 101)}
    assert got[100, 101] == pytest.approx(truth[100, 101], abs=1e-9)


def test_samples_of_many_pairs_are_drawn_in_parts():
    rng = np.random.default_rng(4)
    sizes = [3, 1, 700, 40, 40, 1, 90]
    words = np.concatenate([rng.choice(5000, k, replace=False) for k in sizes]).astype(np.int32)
    times, offsets = rng.integers(1, 4, len(words)).astype(np.int32), np.concatenate(([0], np.cumsum(sizes)))
    df = rng.integers(0, 50, 1 << 12).astype(np.float32)
    whole = near.signatures(words, times, offsets, 900, df, 24)
    assert whole.shape == (len(sizes), 24)
    for most in (1, 16, 300):
        assert (near.signatures(words, times, offsets, 900, df, 24, most) == whole).all()


def test_shingles_are_told_apart_by_the_hashes_of_their_words():
    said = list("abcabcabdxabcab")
    known = {w: np.uint64(rng) for w, rng in zip("abcdx", np.random.default_rng(1).integers(2**63, size=5))}
    hashes = near.window_hashes(np.array([known[w] for w in said], np.uint64), 5)
    assert len(dict(zip(hashes.tolist(), near.shingles(said, 5)))) == len(set(near.shingles(said, 5))) == len(set(zip(hashes.tolist(), near.shingles(said, 5))))


@pytest.mark.parametrize("query", ["p1_found", "p1_collapsed", "p3_found", "p3_groups", "p3_weighted"])
def test_queries_run(spark, tiny, query):
    from gaitloom.llm import queries

    df = queries.queries()[query](spark, tiny)
    assert df.count() >= 0
