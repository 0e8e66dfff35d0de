"""Text rules against literal cases and plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaitloom.functions import lexicon, requests as Q
from gaitloom.functions import text as X


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_captions(spark):
    assert one(spark, X.clean_caption("x"), " Caption:   A person walks. ", "OUTPUT : hi", "a　b c", None) == ["A person walks.", "hi", "a b c", ""]
    assert one(spark, X.searchable(X.clean_caption("x")), "A person walks forward.", "Sorry, I cannot provide that information.", " ", "No visible action is identified here") == [True, False, False, False]
    assert one(spark, X.searchable_captions("x"), ["a", " ", "sorry, no", None], None, schema="x array<string>") == [["a"], []]


def test_titles_and_series(spark):
    assert one(spark, X.motion_title(F.lit("MotionXPP"), "x"), "set9/shake_hands_clip1_2", "walk_12") == ["shake hands", "walk"]
    assert one(spark, X.series_key(F.lit("motionxpp"), "x"), "set9/Shake_Hands_2_clip1", "a/B-C_7") == ["set9 shake hands", "a b c"]
    assert one(spark, X.motion_title(F.lit("interhuman"), "x"), "G001T000") == [""]
    assert one(spark, X.stem_description("x"), "Air_Squat-two/three_.") == ["Air Squat - two / three."]


LITERAL = ["两个人面对面抬手击掌", "两个人高兴地拍手鼓掌", "一个人随着节奏扭动身体跳舞", "跳舞", "先举起小提琴，然后持续拉奏", "台球", "棒球", "篮球", "两个人握手之后互相交换名片", "先把腿绑在一起，然后同步向前走", "Greeting bodies, running & handshakes", "the people's business", "走s", "", "拍手拍手鼓掌 拍"]


def test_search_tokens(spark):
    got = one(spark, X.tokens("x"), *LITERAL, None)
    assert got[:-1] == [lexicon.query_tokens(t) for t in LITERAL] and got[-1] == []
    said = dict(zip(LITERAL, got))
    assert "high" in said[LITERAL[0]] and "clap" in said[LITERAL[1]] and "pat" not in said[LITERAL[1]]
    assert "dance" in said[LITERAL[2]] and "jump" not in said["跳舞"] and "violin" in said[LITERAL[4]] and "billiard" in said["台球"] and "tennis" not in said["台球"]
    assert "baseball" in said["棒球"] and "basketball" not in said["棒球"] and "busines" in said[LITERAL[8]] and "three" in said[LITERAL[9]]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abcdingsey 拍手鼓掌站在跑步杯子x1", max_size=30), min_size=1, max_size=40))
def test_search_tokens_of_any_text(spark, texts):
    assert one(spark, X.tokens("x"), *texts) == [lexicon.query_tokens(t) for t in texts]


def test_two_stemmers_differ(spark):
    assert lexicon.query_tokens("running classes") == ["run", "classe"]
    assert one(spark, X.taxonomy_tokens("x"), "running classes left-hand stories") == [["runn", "class", "left hand", "story"]]


def test_other_forms(spark):
    assert one(spark, X.letters_only("x"), "Ab_c，第 2!", None) == ["abc第2", ""]
    assert one(spark, X.match_key("x"), "Air_Squat (走)") == ["air squat 走"]
    assert one(spark, X.clauses("x"), "walk, then run and jump", "  ", "先走，然后跑") == [["walk", "run", "jump"], [""], ["先走", "跑"]]
    for t in ("walk, then run and jump", "先走，然后跑", "one"):
        assert one(spark, X.clauses("x"), t)[0] == Q.clauses(t)


def test_request_helpers():
    assert Q.clamp("7", 1) == 7 and Q.clamp("x", 3) == 3 and Q.clamp(500, 1, maximum=100) == 100 and Q.clamp("-2", 1) == 0 and Q.clamp("0.5", 0, kind=float) == 0.5
    assert Q.parse_bool("Yes") and not Q.parse_bool("off", True) and Q.parse_bool("?", True) and Q.parse_bool(None) is False
    assert Q.encoder_texts("walk, then run") == ["walk, then run", "run"]
    assert "strum" in Q.semantic_text("先摆好持琴姿势，然后快速扫弦") and Q.semantic_text("walking  forward") == "walking forward"
    assert Q.encoder_query("走路", "I", "在做{query}") == "Instruct: I\nQuery:在做走路" and Q.encoder_query("a b", "I", "z{query}").endswith("Query:a b")


@pytest.mark.parametrize("text", ["Straße weiß", "a\tb\x0bc", "x y"])
def test_squeeze_is_pythons_split(spark, text):
    assert one(spark, X.squeeze("x"), text) == [" ".join(re.split(r"\s+", text))]
