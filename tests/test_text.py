"""Semantics the driver tables can't show, on small fixtures, some in Chinese."""

import pytest

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from stanzaflow.functions import arrays, geo
from stanzaflow.functions import text as T
from stanzaflow.operators import affect, lexicon, segment
from pyspark.sql import functions as F


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_matching_disciplines_differ(spark):
    df = spark.createDataFrame([("ABCDAB",)], ["t"])
    masked = df.select(lexicon.masked_counts("t", ["AB", "BCD"]).alias("x")).first()["x"]
    assert [(h["word"], h["hits"]) for h in masked] == [("BCD", 1), ("AB", 1)]
    assert df.select(lexicon.leftmost_matches("t", ["AB", "BCD"]).alias("x")).first()["x"] == ["AB", "AB"]
    assert df.select(lexicon.undominated("t", ["AB", "ABC", "CD"]).alias("x")).first()["x"] == ["ABC", "CD"]


def test_leftmost_is_longest_and_has_offsets(spark):
    df = spark.createDataFrame([(1, "春風又綠江南岸"), (2, None), (3, "")], ["doc_id", "text"])
    rows = lexicon.leftmost_spans(df, ["江南", "江南岸", "春"]).orderBy("match_no").collect()
    assert [(r["doc_id"], r["word"], r["start_offset"], r["end_offset"]) for r in rows] == [(1, "春", 0, 1), (1, "江南岸", 4, 7)]


def test_excluded_phrases_are_masked(spark):
    df = spark.createDataFrame([("白日白雪",)], ["t"])
    assert [(h["word"], h["hits"]) for h in df.select(lexicon.masked_counts("t", ["白"], ["白日"]).alias("x")).first()["x"]] == [("白", 1)]


@pytest.mark.parametrize(
    "text, terms, excluded, negators, expected",
    [
        ("泪满衣", [("泪", 1.0), ("泪满", 1.8)], (), (), [(0, "泪满", 1.8)]),
        ("不愁", [("愁", 1.0)], (), ("不",), []),
        ("莫愁湖愁", [("愁", 1.0)], ("莫愁湖",), (), [(3, "愁", 1.0)]),
        ("aaa", [("aa", 1.0)], (), (), [(0, "aa", 1.0)]),
        ("abcd", [("abc", 1.0), ("cd", 9.0)], (), (), [(0, "abc", 1.0)]),
    ],
)
def test_interval_hits(spark, text, terms, excluded, negators, expected):
    assert hits_of(spark, text, terms, excluded, negators) == expected


def hits_of(spark, text, terms, excluded=(), negators=(), single=None):
    df = spark.createDataFrame([(text,)], "t string")
    return [tuple(h) for h in df.select(lexicon.accepted_hits("t", terms, excluded, negators, single).alias("x")).first()["x"]]


def plain_hits(text, terms, excluded, negators):
    """The rule told plainly: free occurrences, the longest, heaviest, leftmost first, without overlap."""
    found = []
    for term, weight in terms:
        at, end = 0, 0
        for at in range(len(text)):
            if at < end or not text.startswith(term, at):
                continue
            end = at + len(term)
            if any(text[:at].endswith(n) for n in negators):
                continue
            near = [(p, max(0, at - len(p)), text[max(0, at - len(p)) : end + len(p)]) for p in excluded]
            if any(p in w and lo + w.index(p) <= at and end <= lo + w.index(p) + len(p) for p, lo, w in near):
                continue
            found.append((-len(term), -weight, at, term))
    taken = []
    for n, w, at, term in sorted(found):
        if all(at - n <= a or b <= at for a, b, _, _ in taken):
            taken.append((at, at - n, term, -w))
    return sorted((a, t, w) for a, _, t, w in taken)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", max_size=14), min_size=1, max_size=30))
def test_interval_hits_equal_the_plain_rule(spark, texts):
    terms, excluded, negators = [("ab", 1.0), ("abc", 0.5), ("ca", 2.0), ("b", 1.0), ("aa", 1.0)], ["cab", "bb"], ["bc", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [tuple(h) for h in r["x"]] for r in df.select("i", lexicon.accepted_hits("t", terms, excluded, negators).alias("x")).collect()}
    assert got == {i: plain_hits(t, terms, excluded, negators) for i, t in enumerate(texts)}


def test_single_characters_need_to_be_safe(spark):
    assert hits_of(spark, "愁山", [("愁", 1.0), ("山", 1.0)], single={"愁"}) == [(0, "愁", 1.0)]


def test_running_sums_of_long_arrays(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        values = [i % 7 for i in range(n)]
        got = one(spark, arrays.running_sums("v"), v=values) if n else spark.sql("SELECT array() AS x").select(arrays.running_sums(F.col("x").cast("array<int>")).alias("x")).first()["x"]
        assert got == [sum(values[:i]) for i in range(n)]


def test_places_of_words(spark):
    assert one(spark, arrays.places_of("v", "aa"), v="aaaxaa") == [0, 4]
    assert one(spark, arrays.places_of("v", "aa", overlapping=True), v="aaaxaa") == [0, 1, 4]
    assert one(spark, arrays.places_of("v", "a.\\E"), v="xa.\\Ea.") == [1] and one(spark, arrays.places_of("v", "b"), v="") == []


def test_excluded_context_still_uses_up_the_text(spark):
    df = spark.createDataFrame([(1, "三月明月光"), (2, "月")], "doc_id int, text string")
    rows = lexicon.matches_outside(df, ["月", "明月"], {"月": ("[一二三]", "份")}).collect()
    assert sorted((r["doc_id"], r["word"], r["start_offset"]) for r in rows) == [(1, "明月", 2), (2, "月", 0)]


def test_context_labels(spark):
    rules = {"sad": ["愁", "愁绪"], "glad": ["乐", "喜"]}
    got = one(spark, lexicon.context_labels("v", rules, excluded=["长乐", "莫愁"], negators=["不"]), v="莫愁，长乐。不喜，愁绪")
    assert [(r["label"], r["words"]) for r in got] == [("sad", ["愁绪"])]
    assert [r["label"] for r in one(spark, lexicon.context_labels("v", rules, negators=["不"]), v="不喜，喜")] == ["glad"]


def test_companions_once_each(spark):
    rules = {"月": ["月", "蟾"], "酒": ["酒", "杯"], "风": ["风"]}
    assert one(spark, lexicon.companions("v", rules, but="风"), v="蟾月杯风") == sorted(["月", "酒"])


def test_lines_keep_offsets_and_stanzas(spark):
    body = " 床前明月光。\r\n疑是地上霜；\n\n\n舉頭望明月！低頭思故鄉"
    df = spark.createDataFrame([(7, body)], ["doc_id", "text"])
    rows = segment.split_lines(df, ends=T.CJK_SENTENCE_END).orderBy("line_no").collect()
    assert [r["text"] for r in rows] == ["床前明月光。", "疑是地上霜；", "舉頭望明月！", "低頭思故鄉"]
    assert all(body[r["start_offset"] : r["end_offset"]] == r["text"] for r in rows)
    assert [r["stanza_no"] for r in rows] == [1, 1, 2, 2]


def test_chunks_prefer_a_mark_in_the_last_fifth(spark):
    text = "a" * 90 + "." + "b" * 60
    rows = segment.chunk_text(spark.createDataFrame([(1, text), (2, None), (3, "  ")], ["doc_id", "text"]), limit=100, marks=".").orderBy("chunk_no").collect()
    assert [r["chunk"] for r in rows] == ["a" * 90 + ".", "b" * 60]


def test_hash_keeps_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert len({r[0] for r in df.select(T.content_hash("x", "y", "z")).collect()}) == 2


def test_role_suffixes_leave_a_character(spark):
    assert one(spark, T.strip_suffixes("v", ["撰", "重編"]), v="李白重編撰") == "李白"
    assert one(spark, T.strip_suffixes("v", ["撰"]), v="撰撰") == "撰"


def test_normal_title(spark):
    assert one(spark, T.normal_title("v"), v="《秋興》（其一） A!") == "秋興一a"


def test_damage(spark):
    assert one(spark, T.damaged("v"), v="what?? ") and one(spark, T.damaged("v"), v="a�b")
    assert not one(spark, T.damaged("v"), v="see http://x.example/?a=1&b=?? now?")


@pytest.mark.parametrize("text, year", [("元", 1), ("十", 10), ("十三", 13), ("二十", 20), ("二十七", 27), ("五", 5)])
def test_han_numbers(spark, text, year):
    assert one(spark, geo.han_number("v"), v=text) == year


def test_eras_and_years(spark):
    eras = {"開元": (713, 741)}
    assert one(spark, geo.era_year("n", "k", eras), n="開元", k=13) == 725
    assert one(spark, geo.era_year("n", "k", eras), n="開元", k=40) is None
    r = one(spark, geo.year_range("v"), v="約725-730年, 12345")
    assert (r["low"], r["high"], r["approximate"]) == (725, 730, True)


def test_coordinates(spark):
    bad = [(None, 1.0), (0.0, 0.0), (float("nan"), 30.0), (200.0, 30.0)]
    df = spark.createDataFrame([*bad, (100.0, 30.0)], "lon double, lat double")
    assert [r[0] for r in df.select(geo.valid_point("lon", "lat")).collect()] == [False] * 4 + [True]


def test_fnv1a(spark):
    assert one(spark, geo.fnv1a("v"), v="a") == 0xE40C292C and one(spark, geo.fnv1a("v"), v="foobar") == 0xBF9CF968


def test_season_tie_goes_to_the_last_clue(spark):
    seasons = {"spring": {"花": 3}, "autumn": {"葉": 3}}
    df = spark.createDataFrame([(1, "", "花葉"), (2, "", "葉花"), (3, "花", "葉葉"), (4, "", "x")], ["doc_id", "title", "text"])
    rows = {r["doc_id"]: r["season"] for r in affect.detect_season(df, seasons, "title", "text").collect()}
    assert rows == {1: "autumn", 2: "spring", 3: "spring", 4: None}


def classified(spark, body, title="", clusters=None):
    terms = {"sorrow": [("愁", 1.0), ("泪", 1.0)], "joy": [("喜", 1.0), ("欢喜", 1.8)]}
    dims = [("sorrow", -0.7, 0.4, -0.3), ("joy", 0.8, 0.6, 0.7)]
    df = spark.createDataFrame([(1, body, title)], "doc_id int, text string, title string")
    scores = affect.document_scores(df, terms, clusters or {}, "title", "text", excluded=["莫愁湖"], negators=["不"])
    return scores.select(affect.profile_of("scores", dims).alias("p")).select("p.*").first()


def test_emotions_of_documents(spark):
    none = classified(spark, "山水")
    assert (none["primary"], none["valence"], none["arousal"], none["confidence"], none["confidence_label"], none["rule_hits"]) == (None, 0.0, 0.35, 0.12, "low", 0)
    assert classified(spark, "莫愁湖，不喜")["primary"] is None
    title = classified(spark, "山水", "愁")
    assert title["primary"] == "sorrow" and title["rule_hits"] == 0 and [(x["label"], x["score"]) for x in title["labels"]] == [("sorrow", 0.55)]
    both = classified(spark, "欢喜欢喜，愁泪")
    assert both["primary"] == "joy" and both["mixed"] and both["rule_hits"] == 4
    assert [(x["label"], x["score"]) for x in classified(spark, "残月残月", clusters={"残月": ("sorrow", 0.3)})["labels"]] == [("sorrow", 0.6)]
    assert classified(spark, "愁喜")["primary"] == "joy"  # a tie goes by name


def test_percent_of_dimensions(spark):
    assert [one(spark, affect.percent_of("v"), v=x) for x in (-1.0, 0.0, 0.01, 0.03, 2.0)] == [0, 50, 50, 52, 100]
    assert one(spark, affect.percent_of("v", signed=False), v=0.35) == 35


def test_emotion_confidence_is_the_formula(spark):
    import math

    scores = spark.createDataFrame([(1, "joy", 2.0, 2), (1, "grief", 1.0, 1)], "doc_id int, label string, score double, rule_hits long")
    r = affect.emotion_profile(scores, [("joy", 0.8, 0.6, 0.7), ("grief", -0.7, 0.4, 0.3)]).first()
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    assert {x["doc_id"]: x["primary"] for x in affect.emotion_profile(scores, [("joy", 0.8, 0.6, 0.7)], docs=docs).collect()} == {1: "joy", 2: None}
    w = (2.0**1.12, 1.0)
    assert r["valence"] == pytest.approx((0.8 * w[0] - 0.7 * w[1]) / sum(w), abs=6e-4)
    assert r["confidence"] == pytest.approx(0.18 + 0.38 * (1 - math.exp(-3 / 4.2)) + 0.24 * 2 / 3 + 0.16 * 0.6, abs=6e-4)
    assert r["mixed"] and [x["label"] for x in r["labels"]] == ["joy", "grief"]


def test_chunk_borders():
    assert segment.chunk_borders("", 10, ".") == [0, 0] and segment.chunk_borders("a" * 25, 10, ".") == [0, 10, 20, 25]
    assert segment.chunk_borders("aaaaaaaa." + "b" * 10, 10, ".") == [0, 9, 19]  # the mark ends in the last fifth
    assert segment.chunk_borders("aaaaaaa." + "b" * 10, 10, ".") == [0, 10, 18]  # its end is the fifth's border, not inside
    assert segment.chunk_borders("aaaaaaaaa.b", 10, ".") == [0, 10, 11]


def test_lines_of_awkward_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \r\n\n"), (4, "a" * 3000 + "." + "b." * 700)], "doc_id int, text string").withColumn("line_no", F.lit("x"))
    rows = segment.split_lines(df).collect()
    assert {r["doc_id"] for r in rows} == {4} and len(rows) == 701
    assert max(r["end_offset"] for r in rows) == 4401 and "Exchange" not in segment.split_lines(df)._jdf.queryExecution().executedPlan().toString()


def test_context_joins_neighbours(spark):
    clauses = segment.split_clauses(spark.createDataFrame([(1, "a. b. c")], ["doc_id", "text"]))
    rows = segment.neighbour_context(clauses, "doc_id", "clause_no", "clause").orderBy("clause_no").collect()
    assert [r["context"] for r in rows] == ["a.b.", "a.b.c", "b.c"]
    assert clauses.select(F.max("clause_no")).first()[0] == 3
    near = segment.clauses_in_context(spark.createDataFrame([(1, "a. b. c"), (2, "b")], ["doc_id", "text"]), "b")
    assert {(r["doc_id"], r["clause_no"], r["context"]) for r in near.collect()} == {(1, 2, "a.b.c"), (2, 1, "b")}
