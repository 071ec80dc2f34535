"""Merges with awkward values, gates, sources, sinks and state."""

import json
import time

import pytest
from pyspark.sql import functions as F

from stanzaflow.operators import coverage, evidence, joins, merge, search
from stanzaflow.sources import readers, writers
from stanzaflow.streaming import quota


def test_existing_empty_text_wins_but_null_does_not(spark):
    old = spark.createDataFrame([(1, ""), (2, None)], "id int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string")
    assert {tuple(r) for r in merge.upsert_existing_wins(old, new, ["id"]).collect()} == {(1, ""), (2, "y"), (3, "z")}
    assert {tuple(r) for r in merge.upsert_incoming_wins(old, new, ["id"], ["v"]).collect()} == {(1, "x"), (2, "y"), (3, "z")}


def test_unique_winner_needs_to_be_alone(spark):
    c = spark.createDataFrame([("k", "a", 3), ("k", "b", 3), ("m", "c", 1)], "k string, c string, s int")
    assert {(r["k"], r["winner"]) for r in evidence.unique_winner(c, "k", "c", F.col("s")).collect()} == {("k", None), ("m", "c")}


def test_consensus_needs_equal_lengths(spark):
    s = spark.createDataFrame([("g", "abc"), ("g", "abd"), ("g", "abc"), ("h", "x"), ("h", "xy"), ("i", "ab"), ("i", "cd")], "g string, t string")
    assert {tuple(r) for r in evidence.character_consensus(s, "g", "t").collect()} == {("g", "abc"), ("h", None), ("i", None)}


def test_interval_join_gives_each_pair_once(spark):
    a = spark.createDataFrame([("p", 1, 0, 100), ("p", 2, 50, 60)], "k string, id int, s int, e int")
    b = spark.createDataFrame([("p", 9, 55, 300), ("q", 8, 0, 9)], "k string, jd int, s2 int, e2 int")
    rows = joins.interval_join(a, b, "k", ("s", "e"), ("s2", "e2"), 10).collect()
    assert sorted((r["id"], r["jd"]) for r in rows) == [(1, 9), (2, 9)]


def test_first_available_prefers_order(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in joins.first_available(q, [a, b], ["k"], ["v"]).collect()} == {(1, 1, "a"), (2, 2, "b"), (3, None, None)}


def test_coverage_totals(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("b", "x", 1)], "p string, s string, ok int")
    got = {(r["p"], r["s"], r["level"]): r["good"] for r in coverage.coverage_levels(rows, "p", "s", {"good": F.col("ok") == 1}).collect()}
    assert got[(None, None, 3)] == 2 and got[("a", None, 1)] == 1 and got[("b", "x", 0)] == 1


def test_search_arguments():
    assert search.check_search(" ab ") == "ab" and [search.route(q) for q in ("abc", "ab", "a%")] == ["trigram", "short", "like"]
    for bad in ({"query": "x" * 161}, {"query": "x", "limit": 0}, {"query": "x", "offset": -1}, {"query": "x", "scope": "y"}):
        with pytest.raises(ValueError):
            search.check_search(**bad)


def test_chunk_weighted_vectors(spark):
    rows = spark.createDataFrame([("a", 2.0, [3.0, 0.0]), ("a", 1.0, [0.0, 6.0])], "o string, w double, v array<double>")
    v = search.weighted_mean_vectors(rows, "o", "w", "v", 2).first()["vector"]
    assert v == pytest.approx([2**-0.5, 2**-0.5])


def test_fusion_is_normalised(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, place int")
    got = {r["id"]: r["relevance"] for r in search.reciprocal_rank_fusion([a, a], "id").collect()}
    assert got[1] == 1.0 and got[2] == pytest.approx(61 / 62, abs=1e-6)


def test_rejected_calls_leave_no_trace():
    ok, kept = quota.accept([0, 1, 2, 59, 60, 61, 62], [], limit=2, span=60)
    assert ok == [True, True, False, False, True, True, False] and kept == [60, 61]


def test_quota_pieces_equal_the_whole(spark):
    times = [(1, i, t) for i, t in enumerate([0, 1, 2, 3, 70, 71, 72, 200])]
    df = spark.createDataFrame(times, "user_id int, event_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["allowed"] for r in quota.quota_decisions(df, limit=3).collect()}
    assert [got[i] for i in range(8)] == quota.accept([t for _, _, t in times], [], 3)[0]


def test_quota_stream_keeps_state(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n, seconds in enumerate(([1000, 1001, 1002], [1003, 1061, 1062])):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"user_id": 1, "event_id": n * 10 + i, "s": s}) for i, s in enumerate(seconds)))
        time.sleep(0.05)
    calls = spark.readStream.schema("user_id int, event_id int, s long").option("maxFilesPerTrigger", 1).json(str(src)).withColumn("ts", F.timestamp_seconds("s"))
    q = quota.quota_stream(calls, limit=2).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["event_id"]: r["allowed"] for r in spark.table("decided").collect()}
    assert got == {0: True, 1: True, 2: False, 10: False, 11: True, 12: True}


def test_batches_merge_into_versions(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    for n, rows in enumerate(([(1, "a"), (2, "a")], [(2, "b"), (3, "b")])):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "v": v}) for i, v in rows))
        time.sleep(0.05)
    stream = spark.readStream.schema("id int, v string").option("maxFilesPerTrigger", 1).json(str(src))
    done = quota.merge_batches(stream, root, lambda old, new: merge.upsert_last_row(old, new, ["id"]), str(tmp_path / "ck")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert {tuple(r) for r in readers.read_latest(spark, root).collect()} == {(1, "a"), (2, "b"), (3, "b")}


def test_publish_only_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "t1"), (2, None, "t1")], "id int, v string, at string")
    root = str(tmp_path / "t")
    assert writers.publish(df, root, ("at",))
    assert not writers.publish(df.withColumn("at", F.lit("t2")), root, ("at",))
    assert writers.publish(df.filter("id = 1"), root, ("at",))
    assert readers.read_latest(spark, root).count() == 1


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "t", "poet": "p"}, {"title": " ", "poet": "p"}, {"poet": "q"}]))
    assert readers.read_records(spark, str(tmp_path / "a.json"), "title string, poet string", ["title", "poet"]).count() == 1
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"a": x}\n')
    bad = readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int", strict=False).cache().filter("_corrupt_record is not null")
    assert [r[1] for r in bad.collect()] == ['{"a": x}']
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()


def test_csv_mark_and_jsonp(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿poet,title\n李白,靜夜思\n".encode())
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).columns == ["poet", "title"]
    df = spark.createDataFrame([('cb({"a": [1]});',), ('{"a": 1}',), ("null",), ("cb(null)",), ("<html>",)], "x string")
    assert [r[0] for r in df.select(readers.unwrap_jsonp("x")).collect()] == ['{"a": [1]}', '{"a": 1}', None, None, None]


def test_sections_and_outlines(spark):
    html = "<h2>Notes</h2><p>Long enough text &amp; more</p><p>short</p><script>var p='<p>no</p>'</script><h2>Other</h2><p>Long enough text &amp; more</p>"
    blocks = readers.html_blocks(spark.createDataFrame([(1, html)], "page_id int, html string"))
    rows = readers.titled_sections(blocks).collect()
    assert [(r["heading"], r["text"]) for r in rows] == [("Notes", "Long enough text & more")]
    lines = spark.createDataFrame([("f", 1, "* A"), ("f", 2, "x"), ("f", 3, "** B"), ("f", 4, "y")], "f string, n int, t string")
    assert {(r["heading"], r["text"]) for r in readers.outline_records(lines, "f", "n", "t").collect()} == {("A", "x"), ("B", "y")}


