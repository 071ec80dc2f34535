"""Ordered processes: total orders, state machines, stored index, snapshots, year rows, outlines, page loops, packages."""

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stanzaflow.operators import chronicle, collection, evidence, glossary, joins, linkage, outline, packages, promotion, registry, report, search, stored_index
from stanzaflow.operators import transitions as state
from stanzaflow.operators.glossary import Entry
from stanzaflow.operators.order import carried, numbered
from stanzaflow.operators.stored_index import StoredIndex
from stanzaflow.plans import process_queries
from stanzaflow.sources import markup, readers, snapshot
from stanzaflow.streaming import jobs, quota


def test_wide_rows_keep_their_number(spark):
    wide = spark.range(0, 300_000, 1, 12).select(((F.col("id") * 7919) % 300_000).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"), F.rand(1).alias("r"))
    got = numbered(wide, "k", parts=12)
    assert got.columns == ["k", "text", "r", "_n"]
    assert got.agg(F.count("*"), F.countDistinct("_n"), F.min("_n"), F.max("_n"), F.count_if(F.col("_n") != F.col("k"))).first() == (300_000, 300_000, 0, 299_999, 0)
    two = linkage.interleave(wide.filter("k % 3 > 0"), wide.filter("k % 3 = 0"), "k")
    n = two.agg(F.count("*"), F.countDistinct("slot"), F.min("slot"), F.max("slot"), F.sum(F.length("text"))).first()
    assert tuple(n[:4]) == (300_000, 300_000, 0, 299_999) and n[4] == wide.agg(F.sum(F.length("text"))).first()[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_carried_values_cross_partitions(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), t, r.choice([None, None, t])) for t in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    for order, back in ((["t"], False), ([F.desc("t")], True)):
        got = {x["t"]: x["last"] for x in carried(df, ["k"], order, {"last": F.col("v")}, parts=7).collect()}
        want, last = {}, {}
        for k, t, v in sorted(rows, key=lambda x: -x[1] if back else x[1]):
            last[k] = v if v is not None else last.get(k)
            want[t] = last[k]
        assert got == want


def plain_transitions(records, events, moves, allowed):
    names, own = {*moves, *[m for ms in moves.values() for m in ms]}, dict(sorted(records, reverse=True))
    out, now = {}, {k: v if v in names else None for k, v in own.items()}
    for n, (key, to) in enumerate(events):
        before = now.get(key)
        if key is None or key not in own:
            why = "unknown_record"
        elif before is None or to not in names:
            why = "unknown_state"
        else:
            why = "not_allowed" if not allowed(n) else None if to in moves.get(before, []) else "no_move"
        if why is None:
            now[key] = to
        out[n] = (before, now.get(key), why)
    return out


@pytest.mark.parametrize("seed, block", [(0, 7), (1, 256)])
def test_transitions_equal_a_walk(spark, seed, block):
    r = random.Random(seed)
    moves = {"new": ["open", "dead"], "open": ["done", "new"], "done": ["open"]}
    keys = ["hot"] * 6 + ["a", "b", "c", "gone", None]
    events = [(r.choice(keys), r.choice(["new", "open", "done", "dead", "open", "odd", None])) for _ in range(400)]
    records = [("hot", "new"), ("a", "open"), ("a", "zz"), ("b", "odd"), ("c", "done")]
    df = spark.createDataFrame([(k, t, n, "wide" * (n % 9)) for n, (k, t) in enumerate(events)], "k string, to string, n int, text string")
    got = state.transitions(spark.createDataFrame(records, "k string, st string"), df, "k", "st", "to", ["n"], moves, F.col("n") % 5 != 0, block=block)
    assert got.columns == ["k", "to", "n", "text", "before", "after", "refused"]
    assert {x["n"]: (x["before"], x["after"], x["refused"]) for x in got.collect()} == plain_transitions(records, events, moves, lambda n: n % 5 != 0)


def test_states_settle_and_nothing_happens_without_events(spark):
    records = spark.createDataFrame([("a", "new"), ("b", "new")], "k string, st string")
    events = spark.createDataFrame([("a", "open", 1), ("a", "done", 2), ("a", "dead", 3)], "k string, to string, n int")
    moves = {"new": ["open"], "open": ["done"], "dead": []}
    history = state.transitions(records, events, "k", "st", "to", ["n"], moves)
    assert {tuple(x) for x in state.settled_states(records, history, "k", "st", ["n"]).collect()} == {("a", "done", 1), ("b", "new", 0)}
    none = state.transitions(records, events.limit(0), "k", "st", "to", ["n"], moves)
    assert none.count() == 0 and {tuple(x) for x in state.settled_states(records, none, "k", "st", ["n"]).collect()} == {("a", "new", 0), ("b", "new", 0)}


def test_several_reviews_leave_one_record(spark):
    records = spark.createDataFrame([(1, "O", "old"), (2, "O", "old"), (3, "O", "old")], "k int, st string, note string")
    reviews = spark.createDataFrame([(1, "P", "first", 1), (1, "F", " ", 2), (2, "F", "x", 2), (2, "O", "late", 1), (9, "F", "?", 1)], "k int, st string, note string, n int")
    got = promotion.apply_reviews(records, reviews, "k", "st", {"O": ["F", "P"], "P": ["F"]}, "note", ["n"])
    assert sorted(tuple(x) for x in got.collect()) == [(1, "F", "first", False), (2, "F", "x", True), (3, "O", "old", False)]


def test_repeated_keys_make_no_rows(spark):
    addr = spark.createDataFrame([(1, "x", 100.0, 30.0, 700, 720), (1, "x", 101.0, 31.0, 700, 720), (1, "y", 1.0, 1.0, 0, 0)], "k int, own string, x double, y double, lo int, hi int")
    c = spark.createDataFrame([(1, "x", 710, 711)] * 2, "k int, name string, y1 int, y2 int")
    got = promotion.coordinate_reasons(c, addr, "k", "name", "own", "x", "y", ("y1", "y2"), ("lo", "hi")).collect()
    assert [(r["lon"], r["reason"]) for r in got] == [(100.0, None)] * 2
    child = spark.createDataFrame([(1, "b"), (1, "z"), (2, "z"), (3, None), (4, "q")], "ref int, own string")
    parent = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2, "a"), (3, "a")], "k int, owner string")
    assert tuple(promotion.reference_errors(child, parent, "ref", "k", "own", "owner").first()) == (1, 1, 1)


def test_c_grades_need_two_sources(spark):
    rows = [("k", "v", "s1", "C"), ("k", "v", "s2", "C"), ("k", "w", "s1", "C"), ("k", "w", "s1", "C"), ("k", "w", "s1", "A"), ("k", None, "s1", "C"), ("k", None, "s2", "C"), ("k", "u", "s", "D")]
    df = spark.createDataFrame(rows, "k string, v string, s string, g string")
    assert sorted((x["v"] or "", x["g"], x["publish"]) for x in evidence.publishable(df, "k", "v", "s", "g").collect()) == [
        ("", "C", False), ("", "C", False), ("u", "D", False), ("v", "C", True), ("v", "C", True), ("w", "A", True), ("w", "C", False), ("w", "C", False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_interval_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    spans = [(r.choice("ab"), a := r.randint(-40, 60), a + r.choice([-3, 0, 1, 5, 30]), i) for i in range(40)] + [("a", None, 4, 99), (None, 1, 2, 98)]
    rows = [(r.choice("aaaabc"), r.randint(-60, 110), i) for i in range(300)] + [("a", None, 900), (None, 5, 901)]
    got = {x["row"]: (x["sid"], x["inside"], x["distance"]) for x in joins.nearest_interval(spark.createDataFrame(rows, "k string, v int, row int"), spark.createDataFrame(spans, "k string, s int, e int, sid int"), "k", "row", "v", ("s", "e"), "sid").collect()}
    want = {}
    for k, v, row in rows:
        fit = [(not s <= v <= e, max(s - v, v - e, 0), sid) for kk, s, e, sid in spans if v is not None and s is not None and kk == k and k is not None and s <= e]
        if fit:
            outside, distance, sid = min(fit)
            want[row] = (sid, not outside, distance)
    assert got == want


def test_as_of_takes_the_latest(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3), ("a", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 4, "w")], "k string, u int, v string")
    assert sorted((x["k"], x["t"], x["v"] or "") for x in joins.as_of(left, right, "k", "t", "u", ["v"]).collect()) == [("a", 1, ""), ("a", 5, "z"), ("a", 9, "z"), ("b", 3, "")]


def test_a_set_of_tables_is_read_as_published(spark, tmp_path):
    root, a, b = str(tmp_path / "set"), spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("p",)], "y string")
    assert snapshot.current(spark, root).number == 0
    assert snapshot.publish_set(spark, root, {"a": a, "b": b}, facts={"n": 1}).number == 1
    broken = b.select(F.raise_error(F.lit("no")).cast("string").alias("y"))
    with pytest.raises(Exception, match="no"):
        snapshot.publish_set(spark, root, {"a": a.withColumn("x", F.lit(2)), "b": broken})
    now = snapshot.current(spark, root)
    assert (now.number, now.read("a").collect()[0][0], now.facts) == (1, 1, {"n": 1})
    with pytest.raises(ValueError, match="check"):
        snapshot.publish_set(spark, root, {"a": a}, check=lambda t: t["a"].count() == 0)
    later = snapshot.publish_set(spark, root, {"a": a.withColumn("x", F.lit(2))})
    assert (later.number, later.read("a").first()[0], later.read("b").first()[0]) == (2, 2, "p")
    back = snapshot.roll_back(spark, root, 1)
    assert (back.number, back.read("a").first()[0]) == (3, 1) and snapshot.current(spark, root, 2).read("a").first()[0] == 2
    same = {"a": a, "b": b}
    first = snapshot.publish_set(spark, root, same, skip_equal=True)
    assert snapshot.publish_set(spark, root, same, skip_equal=True).number == first.number
    part = snapshot.publish_set(spark, root, {"a": a, "b": b.withColumn("y", F.lit("q"))}, skip_equal=True)
    assert part.tables["a"] == first.tables["a"] and part.read("b").first()[0] == "q"
    with pytest.raises(ValueError):
        snapshot.current(spark, root, 77)
    with pytest.raises(ValueError):
        snapshot.settled(spark, root, ["a", "c"], lambda s: s.read("c"))


def test_a_stored_index_answers_as_a_scan_does(spark, tmp_path):
    r = random.Random(4)
    words = ["moon", "frost", "Mo", "on", "月光", "\U0001f600x", "the", "then"]
    text = lambda: r.choice([" ", ""]).join(r.choice(words) for _ in range(r.randint(0, 12)))
    held = {i: text() for i in range(60)} | {61: None, 62: "ab"}
    docs = lambda d: spark.createDataFrame(list(d.items()), "doc_id int, text string")
    index = StoredIndex(spark, str(tmp_path / "index"), 4)
    with pytest.raises(ValueError):
        index.search("moon")
    index.add(docs(held))

    def same():
        for q in ("MOO", "then the", "月光月", "\U0001f600xm"):
            want = {tuple(x) for x in search.bm25_scan(docs(held), q).collect()}
            assert {tuple(x) for x in index.search(q).collect()} == want, q

    new = {i: text() for i in range(50, 80)}
    held |= new
    index.add(docs(new))
    gone = [1, 2, 3, 55, 999]
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id int"))
    held = {i: t for i, t in held.items() if i not in gone}
    same()
    again = {2: "moon again", 55: "the moon"}
    held |= again
    index.add(docs(again))
    same()
    plan = index._postings(index._state(), ["moo"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(token,moo)" in plan
    index.compact()
    assert len(index._segments(index._state())) == 1 and "marks" not in index._state().tables
    same()
    with pytest.raises(ValueError):
        index.search("mo")


def test_postings_are_made_where_the_texts_lie(spark, tmp_path):
    """A row of the postings tells of a block of documents; no position is shuffled, and of one id the first text counts."""
    r = random.Random(5)
    texts = {i: "".join(r.choice("abc 月\U0001f600") for _ in range(r.randint(0, 40))) for i in range(400)} | {7: "abcab"}
    index = StoredIndex(spark, str(tmp_path / "index"), 4)
    index.add(spark.createDataFrame([*texts.items(), (7, "~~~~"), (None, "aaa")], "doc_id int, text string"))
    want = {}
    for i, t in texts.items():
        for k in range(len(t) - 2):
            want.setdefault((t[k : k + 3], i), []).append(k)
    assert {(x["token"], x["doc_id"]): x["positions"] for x in index._postings(index._state()).collect()} == want
    kept = index._state().read("postings_1")
    assert kept.count() <= 4 * len({t for t, _ in want}) < len(want)
    blocks = list(stored_index._blocks(iter([pa.record_batch({"doc_id": [1, 2, 3], "text": ["a" * stored_index.BLOCK_CHARS, "aaa", "ab"]})] * 2)))
    assert [(b.num_rows, b.column("ids").to_pylist(), b.column("ends").to_pylist()) for b in blocks] == [(1, [[1]], [[stored_index.BLOCK_CHARS - 2]]), (1, [[2, 1]], [[1, stored_index.BLOCK_CHARS - 1]]), (1, [[2]], [[1]])]


DETAIL = """<div><div class='label1'><a href="ViewDetail?beginYear=725&amp;endYear=726">x</a></div><!-- c -->
 <div class='detail' id='d1'>first &amp; <b>bold</b><div class='inlineComment'>left out</div>
 <a href='/ViewDetail?beginYear=730&endYear=731'>730</a> second <a href='ViewDetail?beginYear=740&endYear='>740</a> lost <i>too</i>
 <a href="/other">kept?</a><a href='ViewDetail?beginYear=-5&endYear=6'>y</a>third</div>
 <div class='label1'><a href="ViewDetail?beginYear=1&endYear=2"></a></div><div class='noise'></div><div class='detail' id='d2'>noise between</div>
 <div class='label1'><a href="ViewDetail?beginYear=1"></a></div><div class='detail' id='d3'>no end</div>
 <div class='label1'><a href="ViewDetail?beginYear=3&endYear=4"></a></div> text <div class='detail x' id='d4'>  <p>last<p>words</div></div>"""


def test_plain_pages_are_read_as_the_parser_reads_them():
    def told(node):
        return node if isinstance(node, str) else (node.name, node.attrs, [told(c) for c in node.children])

    def parsed(page):
        tree = markup._Tree()
        tree.feed(page)
        tree.close()
        return tree.root

    r = random.Random(6)
    plain = ["<div class='detail x' id=\"d1\">", "</div>", "<p>", "</p>", "<br>", "<b>", "</b>", " a &amp; b\n", "&notit; &#x41 &lt", "&amp;amp;", "<!-- a - b -->", "<a href='V?x=1&beginYear=3&copy=4&amp;y'>", "</a>", "<!---->", "</br>", "<a href='a' href=\"b\">"]
    other = ["<br/>", "<", "&", "<B>", "<script>", "</script>", "<!-->", "<a b>", "<a c=d>", "<!doctype html>", "</ div>", "<title>", "\x00", "\r\n", "<a b='x'c='y'>", "<p\x0bq='1'>", "<!-- a -- b -->"]
    n_plain = 0
    for n in range(4000):
        page = "".join(r.choice(plain + other * (n % 2)) for _ in range(r.randint(0, 12)))
        fast = markup._plain_tree(page)
        n_plain += fast is not None
        assert fast is None or told(fast) == told(parsed(page)), page
    assert n_plain > 1900


def test_pages_of_orders_are_dealt_by_their_number(spark, sf_dir):
    """A page costs more than its bytes tell: adaptive execution must not put all of them into one task."""
    df = process_queries.marker_year_rows(spark, sf_dir)
    df.collect()
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_year_rows_between_siblings(spark):
    df = spark.createDataFrame([(1, DETAIL), (2, None), (3, "<div class='detail'>alone</div>")], "page_id int, html string")
    got = [tuple(x)[2:7] for x in markup.year_rows(df, left_out="div.inlineComment").orderBy("page_id", "row_index").collect()]
    assert got == [("d1", 0, 725, 726, "first & bold"), ("d1", 1, 730, 731, "second"), ("d1", 2, -5, 6, "third"), ("d4", 3, 3, 4, "lastwords")]


def test_nested_work_lists(spark):
    html = """<ul><li><a href='Query.aspx?id=1'>One</a> <span class='author'>Ann</span> (约725年作)<ul><li><a href='Query.aspx?id=2'>Two</a><span class=time>730-731</span></li></ul></li>
    <li>no link<ul><li><a href='Query.aspx?id=3'>Three</a> <span class='author'>Bob</span></li></ul></li><li><a href='Query.aspx?id=4'></a></li></ul>"""
    df = spark.createDataFrame([(1, html), (2, "")], "page_id int, html string")
    entries = markup.work_years(markup.list_entries(df, item="li"))
    got = [(r["entry_no"], r["parent_no"], r["depth"], r["title"], r["author"], r["years"], r["precision"]) for r in entries.orderBy("entry_no").collect()]
    assert got == [(0, None, 0, "One", "Ann", [725], "exact"), (1, 0, 1, "Two", None, [730, 731], "range"), (2, None, 0, "Three", "Bob", [], "unknown")]
    assert markup.work_years(markup.list_entries(df, item="li"), F.lit("Ann")).count() == 2


OUTLINE = """* Poetry
** KR4 one title
:PROPERTIES:
:_RESP: someone
:_RESP: other
:END:
**** 人物
***** Li Bai
:DYNASTY: Tang
:FUNCTION: author
***** Du Fu
**** Notes
***** not a person
** KR5 two
:KEY:
* Prose
** KR6 three
**** 人物表
***** Su Shi
:DATES: 1037-1101"""


def test_outline_stacks_and_nested_records(spark):
    rows = [("f", n, t) for n, t in enumerate(OUTLINE.split("\n"))] + [("g", 0, "no heading"), ("g", 1, "")]
    tree = outline.outline_tree(spark.createDataFrame(rows, "f string, n int, text string"), "f", "n", "text")
    paths = {(r["f"], r["n"]): [h["title"] for h in r["path"]] for r in tree.collect()}
    assert paths["f", 8] == ["Poetry", "KR4 one title", "人物", "Li Bai"] and paths["f", 13] == ["Poetry", "KR5 two"] and paths["f", 15] == ["Prose"] and paths["g", 0] == []
    assert len(paths) == len(rows)
    got = {r["title"]: (r["category"], r["properties"], [(p["name"], p["properties"]) for p in r["people"]]) for r in outline.nested_records(tree, "f", "n", "text", 2, "人物", 1).collect()}
    assert got == {
        "KR4 one title": ("Poetry", {"PROPERTIES": "", "_RESP": "someone", "END": ""}, [("Li Bai", {"DYNASTY": "Tang", "FUNCTION": "author"}), ("Du Fu", {})]),
        "KR5 two": ("Poetry", {"KEY": ""}, []),
        "KR6 three": ("Prose", {}, [("Su Shi", {"DATES": "1037-1101"})]),
    }
    assert outline.outline_tree(spark.createDataFrame([], "f string, n int, text string"), "f", "n", "text").count() == 0


def test_deep_payloads_lose_nothing(spark):
    deep = "x"
    for i in range(12):
        deep = {"a": deep, "n": i} if i % 2 else [deep, None, i]
    df = spark.createDataFrame([(1, json.dumps({"m": "top", "d": deep})), (2, "not json"), (3, "5"), (4, None), (5, "{}")], "id int, j string")
    got = {(r["id"], r["path"]): (r["value"], r["block"]) for r in readers.payload_tree(df, "id", "j", "m").collect()}
    path = "$.d" + ".a[0]" * 6
    assert got[1, path] == ("x", "top") and got[3, "$"] == ("5", None) and {i for i, _ in got} == {1, 3} and len(got) == 2 + 6 * 3 + 1


def test_person_records_and_lists(spark):
    one = {"Package": {"PersonAuthority": {"PersonInfo": {"Person": {"BasicInfo": {"PersonId": "7", "ChName": "Li", "IndexYear": "701"}, "PersonAddresses": {"Address": {"AddrName": " x ", "FirstYear": ""}}}}}}}
    two = {"Person": {"id": 8, "Name": "Du", "PersonAddresses": {"Address": [{"AddrName": "y"}, "odd", {"AddrName": "z", "FirstYear": 750}]}}}
    df = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps(two)), (3, "[]"), (4, '{"Person": "no"}'), (5, None)], "i int, j string")
    people = readers.person_records(df, "i", "j")
    assert sorted(tuple(r)[:4] for r in people.collect()) == [(1, "7", "Li", "701"), (2, "8", "Du", None)]
    got = readers.person_lists(people, "i", "PersonAddresses", "Address", {"name": "AddrName", "year": "FirstYear"})
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "x", None), (2, 0, "y", None), (2, 2, "z", "750")]


def test_glosses_by_line(spark):
    entries = [Entry("t1", ("moon", "moonlight"), "d1"), Entry("t2", ("light",), "d2"), Entry("t3", ("zz",), "d3", status="draft")]
    lines = spark.createDataFrame([(1, 1, "a moonlight light moon zz", 10), (1, 2, "none", 40), (2, 1, None, 0)], "doc_id int, line_no int, text string, start_offset int")
    got = sorted(tuple(r)[:6] for r in glossary.gloss_lines(lines, entries).collect())
    assert got == [(1, 1, "light", 12, 17, 22), (1, 1, "moon", 18, 22, 28), (1, 1, "moonlight", 2, 11, 12)]
    for bad in ([Entry("a", ("xy",), "d"), Entry("a", ("zw",), "d")], [Entry("a", ("x",), "d")], [Entry("a", ("xy",), "d"), Entry("b", ("xy",), "d")], [Entry("a", ("xy",), " ")]):
        with pytest.raises(ValueError):
            glossary.checked(bad)


def test_page_loops_stop_for_a_reason(spark):
    ok = lambda s, p, n, f, more=True: (s, p, "ok", n, f, more)
    pages = [ok("empty", 0, 3, "a"), ok("empty", 1, 0, "b"), ok("empty", 2, 5, "c")]
    pages += [ok("again", 0, 3, "a"), ok("again", 1, 2, "b"), ok("again", 2, 3, "a"), ok("again", 3, 9, "z")]
    pages += [ok("last", 0, 1, "a"), ok("last", 1, 1, "b", False), ("fail", 0, "ok", 2, "a", True), ("fail", 1, "http", 0, None, None), ("dead", 0, "http", 0, None, None)]
    pages += [ok("long", p, 1, f"p{p}") for p in range(6)] + [ok("gap", 0, 1, "a"), ok("gap", 2, 1, "b"), ok("gap", 0, 1, "a")]
    df = spark.createDataFrame(pages, "s string, p int, st string, n int, f string, more boolean")
    out = collection.page_outcomes(df, "s", "p", "st", "n", "f", "more", 4)
    got = {r["s"]: tuple(r)[1:] for r in collection.collection_status(out, "s", "p", "n", 4).collect()}
    assert got == {
        "empty": ("collected", "empty_page", 2, None, 3, True), "again": ("collected", "repeated_page", 3, None, 5, True), "last": ("collected", "no_next_page", 2, None, 2, True),
        "fail": ("partial", None, 1, 2, 2, False), "dead": ("fetch_failed", None, 0, 1, 0, False), "long": ("partial", "hard_limit_reached", 4, None, 4, False), "gap": ("collected", None, 1, None, 1, False),
    }
    rows = spark.createDataFrame([("empty", 0, "c1", 1), ("empty", 0, "c2", 2), ("empty", 2, "c3", 3), ("last", 1, "c1", 9)], "s string, p int, id string, v int")
    assert sorted((r["id"], r["v"]) for r in collection.recovered(rows, out, "s", "p", "id", ["v"]).collect()) == [("c1", 1), ("c2", 2)]


def test_years_fall_into_scenes(spark):
    df = spark.createDataFrame([("a", y) for y in (1, 2, 2, 3, 7, 20, None)] + [("b", 5)], "k string, y int")
    found = chronicle.scenes(df, "k", "y")
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 1, 3, 3, 4), ("a", 2, 7, 7, 1, 1), ("a", 3, 20, 20, 1, 1), ("b", 1, 5, 5, 1, 1)]
    gaps = chronicle.segments(found, "k", 5)
    assert sorted(tuple(r) for r in gaps.collect()) == [("a", 1, 2, 4, True), ("a", 2, 3, 13, False)]
    assert sorted(tuple(r) for r in chronicle.stories(found, gaps, "k").collect()) == [("a", 3, 2, 1, 1, 20, 3), ("b", 1, 0, 0, 5, 5, 1)]


def test_packages_nest_what_differs(spark):
    claims = [(1, "date", "725", 1, 0.5, "s1", "p1"), (1, "date", "726", 2, 0.9, "s2", None), (1, "date", "726", 3, 0.9, "s2", "p0"), (1, "note", "b", 4, 0.1, None, "x"), (1, "note", "a", 5, 0.1, "s1", "p9"), (1, "note", "a", 6, 0.1, "s1", "p9"), (2, "note", " ", 7, 0.1, "s1", "z"), (3, "place", "x", 8, 1.0, "s1", "q")]
    df = spark.createDataFrame(claims, "k int, kind string, value string, id int, c double, s string, l string")
    got = {r["k"]: r for r in packages.packages(df, "k", "kind", "value", "id", "c", "s", "l", ["date", "place"], ["note"]).collect()}
    assert set(got) == {1, 3}
    assert tuple(got[1]["composition"]["date"]) == ("726", 0.9, 3, 2) and got[1]["notes"]["note"] == ["a", "b"] and got[1]["controversy"] == ["date"]
    assert [tuple(s) for s in got[1]["sources"]] == [("s1", "p1", 3), ("s2", "p0", 2)] and not got[1]["complete"]
    assert tuple(got[3]["composition"]["date"]) == (None, None, 0, 0) and got[3]["quality"].asDict() == {"date": False, "place": True, "note": False}


def feed(folder, n, rows):
    (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    time.sleep(0.05)


def test_clients_that_stay_away_are_forgotten(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "user_id int, event_id int, s long"

    def run():
        got = {}
        calls = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)).withColumn("ts", F.timestamp_seconds("s"))
        keep = lambda df, _: got.update({r["event_id"]: r["allowed"] for r in df.collect()})
        q = quota.quota_stream(calls, limit=2, late="0 seconds").writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        kept = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
        return got, kept[-1]

    feed(src, 0, [{"user_id": 1, "event_id": i, "s": 1000 + s} for i, s in enumerate([0, 1, 2])])
    assert run()[0] == {0: True, 1: True, 2: False}
    feed(src, 1, [{"user_id": 1, "event_id": 10, "s": 1030}, {"user_id": 2, "event_id": 11, "s": 1031}])  # the state is that of the checkpoint
    got, full = run()
    assert got == {10: False, 11: True}
    feed(src, 2, [{"user_id": 2, "event_id": 20, "s": 1500}])
    feed(src, 3, [{"user_id": 1, "event_id": 30, "s": 1501}, {"user_id": 1, "event_id": 31, "s": 1502}])
    got, left = run()
    assert got == {20: True, 30: True, 31: True}
    feed(src, 4, [{"user_id": 3, "event_id": 40, "s": 9000}])
    feed(src, 5, [{"user_id": 3, "event_id": 41, "s": 9001}])
    assert run()[1] < left  # the clients that stay away are forgotten


def test_jobs_go_on_after_a_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def run(name):
        got = {}
        events = spark.readStream.schema("job_id int, event_id int, kind string, input_hash string").json(str(src))
        keep = lambda df, _: got.update({r["event_id"]: (r["status"], r["attempts"], r["refused"]) for r in df.collect()})
        q = jobs.job_stream(events, name).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return got

    row = lambda e, kind, h="h", j=1: {"job_id": j, "event_id": e, "kind": kind, "input_hash": h}
    feed(src, 0, [row(1, "start"), row(2, "submit"), row(3, "start"), row(4, "start"), row(5, "submit", j=2), row(6, "start", j=2), row(7, "done", j=2)])
    assert run("run_a") == {1: (None, 0, True), 2: ("pending", 0, False), 3: ("running", 1, False), 4: ("running", 1, True), 5: ("pending", 0, False), 6: ("running", 1, False), 7: ("completed", 1, False)}
    feed(src, 1, [row(11, "done"), row(12, "start"), row(13, "fail"), row(14, "start"), row(15, "submit", j=2), row(16, "submit", "other", j=2)])
    assert run("run_b") == {11: ("pending", 1, True), 12: ("running", 2, False), 13: ("failed", 2, False), 14: ("running", 3, False), 15: ("completed", 1, False), 16: ("pending", 0, False)}
    table = spark.createDataFrame([(1, "running", "a"), (2, "running", "b"), (3, "failed", "a")], "id int, status string, run string")
    assert [r["status"] for r in jobs.reset_running(table, stale=F.col("run") != "b").orderBy("id").collect()] == ["pending", "running", "failed"]


def test_registry_keeps_what_was_verified(spark):
    kind = "owner string, era string, status string, author_id bigint, candidate_ids array<bigint>, stale_ids array<bigint>, conflict_ids array<bigint>, verified boolean, verified_at string, discovery_conflict bigint"
    row = lambda o, st, i=None, ok=False, stale=(): (o, "tang", st, i, [], list(stale), [], ok, "t0" if ok else None, None)
    fresh = [row("a", "name_query"), row("b", "name_query"), row("c", "identity_ambiguous"), row("d", "probe_unique", 4), row("e", "probe_unique", 5), row("f", "audited_seed", 6), row("g", "audited_seed", 7), row("h", "name_query")]
    old = [row("a", "discovered", 1, True, [9]), row("b", "discovered", 2), row("c", "audited_seed", 3, True), row("d", "discovered", 4, True), row("e", "discovered", 55, True), row("f", "discovered", 6, True), row("g", "discovered", 77)]
    got = {r["owner"]: tuple(r[c] for c in ("status", "author_id", "stale_ids", "verified", "discovery_conflict")) for r in registry.preserved(spark.createDataFrame(fresh, kind), spark.createDataFrame(old, kind)).collect()}
    assert got == {
        "a": ("discovered", 1, [9], True, None), "b": ("name_query", None, [2], False, None), "c": ("identity_ambiguous", None, [3], False, None), "d": ("discovered", 4, [], True, None),
        "e": ("probe_unique", 5, [55], False, 55), "f": ("audited_seed", 6, [], True, None), "g": ("audited_seed", 7, [77], False, None), "h": ("name_query", None, [], False, None),
    }
    found = [("h", 1, 8, "h", "tang", "t1"), ("h", 2, 88, "h", "tang", "t2"), ("h", 3, 8, "h", "tang", "t3"), ("c", 1, 3, "c", "tang", "t1"), ("b", 1, 2, "other", "tang", "t1"), ("a", 1, 1, "a", "song", "t1"), ("g", 1, 7, "g", "tang", "")]
    now = registry.discovered(spark.createDataFrame(fresh, kind), spark.createDataFrame(found, "owner string, n int, author_id bigint, verified_name string, verified_era string, verified_at string"))
    got = {r["owner"]: tuple(r[c] for c in ("status", "author_id", "stale_ids", "verified_at", "discovery_conflict")) for r in now.collect()}
    assert got["h"] == ("discovered", 8, [], "t3", 88) and got["c"] == ("identity_ambiguous", None, [3], None, None) and got["a"][:2] == ("name_query", None) and got["b"][1] is None and got["g"][3] is None


def test_picks_are_topped_up(spark):
    rows = [(i, "g" if i < 6 else f"h{i}", 100 - i, i % 4 == 3) for i in range(12)]
    df = spark.createDataFrame(rows, "i int, g string, q int, easy boolean")
    from stanzaflow.operators import stylometry

    got = stylometry.capped_picks(df, "i", "g", [F.desc("q"), "i"], 2, 3, F.col("easy"), 2)
    assert sorted((r["i"], r["pass"]) for r in got.collect()) == [(0, 1), (1, 1), (6, 1), (7, 2), (11, 2)]  # 3 is easy, but its group is full


def test_pages_about_something_else_give_nothing(spark):
    page = lambda title, h1: f"<title>{title}</title><h1>{h1} <i>x</i></h1><h2>Background</h2><p>one two three</p><p>four</p><h2>Other</h2><p>not this one</p>"
    df = spark.createDataFrame([(1, page("A Poem - site", "z"), "A Poem"), (2, page("t", "A Poem"), "A Poem"), (3, page("t", "z"), "A Poem"), (4, page("t", "z"), ""), (5, None, "A Poem")], "page_id int, html string, want string")
    got = readers.guarded_sections(df, "want", ["Background"])
    assert sorted(tuple(r) for r in got.collect()) == [(i, "Background", "one two three four") for i in (1, 2, 4)]


def test_rows_split_in_a_fixed_order(spark):
    rows = [("b", "s2", "work", 1), ("a", "s1", "work", 2), ("z", "s1", "work", 0), ("a", "s2", None, 3), ("a", "s1", "event", 4), ("b", "s1", "work", 9)]
    works, events = report.split_in_order(spark.createDataFrame(rows, "p string, s string, k string, n int"), "k", "work", {"p": ["b", "a"], "s": ["s1", "s2"]}, ["n"])
    assert [r["n"] for r in works.collect()] == [9, 1, 2, 0] and [r["n"] for r in events.collect()] == [4, 3]
