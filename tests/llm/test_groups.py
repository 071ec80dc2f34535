"""Near duplicates, embeddings, mixing, sharding, toxicity, HTML and the pipeline against plain versions."""

import math
import pathlib
import random
import re

import numpy as np
import pytest
from awkward import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stanzaflow.llm import boost, decontam, dom, graph, html_extract, metric_join, minhash, mixing, sharding, toxicity
from stanzaflow.llm.html_pages import generated_pages


def plain_components(n, edges):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_rings(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 30)] + [(40, 41 + i) for i in range(20)] + [(70, 71), (71, 72), (72, 70), (80, 80)]
    edges = [(b, a) if r.random() < 0.5 else (a, b) for a, b in edges]
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = plain_components(100, edges)
    assert got == {i: want[i] for i in got} and set(got) == {i for e in edges for i in e} - {80}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def edited(r, words, share):
    return [f"e{r.random()}" if r.random() < share else w for w in words]


def near_corpus():
    r = random.Random(3)
    rows = []
    for base in range(4):
        words = [f"w{base}_{r.randrange(400)}" for _ in range(r.choice([9, 60, 150]))]
        for _ in range(30):
            rows.append(" ".join(edited(r, words, r.choice([0, 0.005, 0.01, 0.02, 0.05, 0.2]))))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"q{k}_{i}" for i in range(r.randrange(5, 80))) for k in range(40)]
    return [*rows, None, "", "  ", "one two", "One  two", "one two three four five", "x"]


def test_near_duplicates_equal_all_pairs(spark):
    texts = near_corpus()
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0)})
    edges = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = plain_components(len(texts), edges)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r["kept"] == (i == want[i]) for i, r in got.items()) and len(set(want)) < len(want) - 60
    kept = minhash.drop_near_duplicates(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_awkward(spark, docs_of):
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs_of(AWKWARD)).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (6, 5)]
    assert minhash.near_duplicates(docs_of([])).count() == 0
    assert sorted(r["doc_id"] for r in minhash.drop_near_duplicates(docs_of(AWKWARD)).collect()) == [1, 2, 3, 4, 5]


def test_circulant_signature_estimates():
    r = np.random.default_rng(1)
    common, a, b = (r.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(3))
    x, y, a, b = minhash.band_hashes([np.unique(np.r_[common, a[:10]]), np.unique(np.r_[common, b[:10]]), a, b])
    assert (x == y).mean() > 0.8 and (a == b).mean() < 0.1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbé \t\n\x0b\x1f\u3000"), max_size=60), max_size=6), st.sampled_from([4, 1 << 17]))
def test_shingles_are_those_of_the_words(texts, piece):
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t)) for t in texts]
    plain = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0)} for w in words]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(minhash, "PIECE", piece)
        got = minhash.shingle_sets(texts)
        apart = [minhash.shingle_sets([t])[0] for t in texts]
    assert [x.tolist() for x in got] == [x.tolist() for x in apart] and [len(x) for x in got] == [len(p) for p in plain]
    for a, p in zip(got, plain):
        for b, q in zip(got, plain):
            assert len(np.intersect1d(a, b)) == len(p & q)


def test_parities_bound_the_difference():
    r = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 1 << 62, r.integers(1, 400)).astype(np.uint64)) for _ in range(2))
        a, b = np.union1d(a, b[: r.integers(0, 300)]), np.union1d(b, a[: r.integers(0, 300)])
        differ = int(np.bitwise_count((minhash.parities(a) ^ minhash.parities(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0
    assert not (minhash.parities(a) ^ minhash.parities(a)).any()


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = ("one two three four five six " + x for x in ("apple", "pear", "fig"))
    df = spark.createDataFrame([(7, a), (7, b), (3, b), (9, a.upper()), (7, a), (4, c), (4, c.upper()), (None, a), (None, a), (8, ""), (8, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect()))
    assert got == [(0, 0, True)] * 2 + [(3, 3, True), (4, 4, True), (4, 4, True), (7, 3, False), (7, 7, True), (7, 7, True), (8, 8, True), (8, 8, True), (9, 7, False)]
    kept = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in minhash.drop_near_duplicates(df).collect())
    assert kept == sorted([(0, a), (0, a), (7, a), (3, b), (4, c), (8, ""), (8, "")])


def test_hot_keys_lose_nothing(spark, monkeypatch):
    from stanzaflow.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 1 << 40)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    test_near_duplicates_equal_all_pairs(spark)


@pytest.mark.parametrize("cell", [2048, 12])
def test_vector_links_equal_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    r = np.random.default_rng(2)
    rows, base = [], r.normal(size=(6, 8))
    for i in range(160):
        v = base[i % 6] + r.normal(size=8) * r.choice([0.0, 0.05, 0.12, 0.6])
        rows.append((i, [float(np.float32(x)) for x in v * r.choice([1.0, 3.0])], int(i % 2)))
    rows += [(200, rows[0][1], 0), (201, None, 0), (202, [0.0] * 8, 0), (203, [1.0, None] * 4, 0), (204, [math.nan] * 8, 0), (205, rows[0][1], None), (206, [1.0], 0), (207, [], 1)]
    n = len(rows)
    good = [bool(v) and None not in v and np.isfinite(v).all() and any(v) and lab is not None for _, v, lab in rows]
    edges = []
    for j in range(n):
        for i in range(j):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.98:
                    edges.append((i, j))
    degree, comp = np.bincount(np.array(edges).ravel(), minlength=n), plain_components(n, edges)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = {x["vec_id"]: x for x in metric_join.link_vectors(df).collect()}
    assert [got[row[0]]["n_links"] for row in rows] == degree.tolist() and len(edges) > 100
    assert [got[row[0]]["component_id"] for row in rows] == [rows[c][0] for c in comp]
    assert metric_join.link_vectors(df.limit(0)).count() == 0


def test_vectors_of_any_size_and_repeated_ids(spark):
    big, small = [1e200, 2e200], [1e-200, 2e-200]
    rows = [(1, big, 0), (2, small, 0), (3, [5e-324, 1e-323], 0), (4, [1e308, -1e308], 0), (5, [1.0, 2.0], 0), (9, [3.0, 1.0], 0), (9, [1.0, 2.0], 0), (9, [3.0, 1.0], 0), (8, [3.0, 1.0], 0), (None, [3.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("n_links", F.lit("x")).withColumn("rep", F.lit(1))
    got = sorted((x["vec_id"] or 0, x["n_links"], x["component_id"] or 0, x["kept"]) for x in metric_join.link_vectors(df).collect())
    assert got == sorted([(i, 4, 1, i == 1) for i in (1, 2, 3, 5, 9)] + [(4, 0, 4, True), (0, 0, 0, True), (8, 2, 8, True)] + [(9, 2, 8, False)] * 2)


def test_mixing_reaches_the_targets(spark, docs_of):
    rows = [(i, "x" * 20, "en", "big") for i in range(3000)] + [(10_000 + i, "y" * 20, "en", "small") for i in range(300)] + [(20_000, None, "en", None)]
    targets = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    got = mixing.mix(docs_of(rows), targets)
    n = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["big"] - 1650) < 200 and abs(n["small"] - 1650) < 250  # rates 0.55 and 5.5
    assert got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"), F.max("copy").alias("c")).filter("n <> m or c <> m - 1").count() == 0
    again = mixing.mix(docs_of(rows).repartition(7), targets)
    assert again.exceptAll(got).count() == 0 and got.exceptAll(again).count() == 0
    assert mixing.mix(docs_of([])).count() == 0
    assert set(got.columns) == {*docs_of(rows).columns, "rate", "n_copies", "copy", "shuffle_key"}


def test_mixing_keeps_columns_of_any_name(spark, monkeypatch):
    rows = [(i, "x" * (i % 7), f"s{i % 5}", float(i), "k") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _rate double, _Mix string").withColumn("copy", F.lit("old")).withColumn("_cdf", F.lit(1))
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "text", "source", "_rate", "_Mix", "_cdf", "rate", "n_copies", "copy", "shuffle_key"]
    assert {(r["doc_id"], r["_rate"]) for r in got.collect()} <= {(i, float(i)) for i in range(60)}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 4)  # too many sources for a broadcast of all
    assert sorted(map(repr, mixing.mix(df).collect())) == sorted(map(repr, got.collect()))


def test_poisson_inversion(spark, docs_of):
    rates = mixing._with_thresholds(spark.createDataFrame([(0.7,), (20.0,)], "rate double")).collect()
    assert [r["parts"] for r in rates] == [1, 3]
    p = math.exp(-0.7)
    assert rates[0]["cdf"][:3] == pytest.approx([p, p * 1.7, p * (1.7 + 0.245)])


def test_shards_are_even_gapless_and_together(spark, docs_of):
    r = random.Random(7)
    rows = [(i, "hot copy", "en", "a") for i in range(160)] + [(1000 + i, f"pair {i // 2}", "en", "a") for i in range(120)] + [(5000 + i, f"text {r.random()}", "en", "b") for i in range(203)]
    rows += [(9000, None, "en", "c"), (9001, "", "en", "c"), (9001, "", "en", "c")]
    got = sharding.assign_shards(docs_of(rows)).collect()
    assert sorted(x["doc_id"] for x in got) == sorted(i for i, *_ in rows)
    by_shard = {}
    for x in got:
        by_shard.setdefault(x["shard"], []).append(x["slot"])
    sizes = [len(by_shard.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    pairs = {}
    for x in got:
        if 1000 <= x["doc_id"] < 1120:
            pairs.setdefault((x["doc_id"] - 1000) // 2, set()).add(x["shard"])
    assert sum(len(v) > 1 for v in pairs.values()) <= 12  # a random deal parts nearly all 60
    hot = {x["shard"] for x in got if x["doc_id"] < 160}
    assert len(hot) < 40
    few = sharding.assign_shards(docs_of(rows[:5])).collect()
    assert len(few) == 5 and all(x["slot"] == 0 for x in few) and sharding.assign_shards(docs_of([])).count() == 0


def shards_of_groups(got, quota):
    """For each group of several rows: the shards it is in, and the fewest its size needs."""
    groups = {}
    for x in got:
        groups.setdefault(x["grp"], []).append(x["shard"])
    return [(len(set(v)), -(-len(v) // quota)) for v in groups.values() if len(v) > 1]


@pytest.mark.parametrize("copies", ["pairs", "nearly a shard", "over a shard", "many sizes"])
def test_shards_cut_no_group_that_fits(spark, copies):
    texts = {
        "pairs": [f"p{i // 2}" for i in range(3200)],
        "nearly a shard": [f"b{i // 78}" for i in range(3120)] + [f"s{i}" for i in range(80)],
        "over a shard": [f"b{i // 155}" for i in range(3100)] + [f"s{i}" for i in range(100)],
        "many sizes": [f"g{i * i % 977}" for i in range(2800)] + [f"s{i}" for i in range(400)],
    }[copies]
    got = sharding.assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(3200))
    assert sorted((x["shard"], x["slot"]) for x in got) == [(t, k) for t in range(40) for k in range(80)]
    assert all(there == fewest for there, fewest in shards_of_groups(got, 80))


def test_shards_settle_many_small_groups_in_rounds(spark):
    texts = [f"p{i // 2}" for i in range(6000)] + [f"t{i // 3}" for i in range(6000)]
    got = sharding.assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted((x["shard"], x["slot"]) for x in got) == [(t, k) for t in range(40) for k in range(300)]
    assert sum(there > fewest for there, fewest in shards_of_groups(got, 300)) <= 39  # a shard filled to the last row for each cut


def test_sharded_texts_are_whole(spark, docs_of):
    got = sharding.shard_documents(docs_of(AWKWARD))
    assert got.columns == [*docs_of(AWKWARD).columns, "shard", "slot"]
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == sorted((i, t or "") for i, t, _, _ in AWKWARD)


def test_rows_equal_in_id_and_text_stay_themselves(spark):
    rows = [(1, "same", "en", "s1"), (1, "same", "de", "s2"), (1, "same", "en", "s1"), (None, None, None, None), (2, "", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, grp string").withColumn("_row", F.lit(7)).withColumn("label", F.lit("x")).withColumn("size", F.lit(1.5))
    got = sharding.shard_documents(df, 2)
    assert got.columns == [*df.columns, "shard", "slot"]
    assert sorted(repr(tuple(r[:7])) for r in got.collect()) == sorted(repr(tuple(r)) for r in df.collect())
    assert sorted((r["shard"], r["slot"]) for r in got.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


def test_copies_are_not_neighbours(spark):
    texts = [f"t{i // 8}" for i in range(1600)]
    got = sharding.assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 4).orderBy("shard", "slot").collect()
    assert all(there == fewest for there, fewest in shards_of_groups(got, 400))
    assert sum(a["grp"] == b["grp"] for a, b in zip(got, got[1:])) < 100  # one behind another they would be 1400


def test_cut_edges_against_a_plain_deal(spark):
    """Links between equal texts that end in two shards: none here, where the starting deal cuts nearly all."""
    r = random.Random(9)
    texts = [f"g{r.randrange(300)}" for _ in range(1000)] + [f"s{i}" for i in range(1000)]
    got = {x["doc_id"]: x["shard"] for x in sharding.assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    pairs = [(i, j) for j in range(1000) for i in range(j) if texts[i] == texts[j]]
    dealt = [r.randrange(40) for _ in texts]
    assert sum(got[i] != got[j] for i, j in pairs) == 0 and sum(dealt[i] != dealt[j] for i, j in pairs) > 0.9 * len(pairs)


def spark_hash(*values):
    """Spark's xxhash64 of strings and ints."""
    import xxhash

    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(4, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def plain_propagation(votes, quotas, large=16, buckets=1024):
    """The rounds told in plain loops: label by group, and pieces of groups that are spread."""
    room, labels, spread, r = list(quotas), {}, {}, 0
    size = {g: sum(v.values()) for g, v in votes.items()}
    borders = [max(quotas) // (1 << k) for k in range((large - 1).bit_length() + 1)]
    kind = {g: sum(n <= b for b in borders) for g, n in size.items() if n > 1}
    for k in sorted(set(kind.values())):
        waiting, left = [g for g in kind if kind[g] == k], []
        while True:
            asked = {}
            for g in waiting:
                fits = [t for t, x in enumerate(room) if x >= size[g]]
                voted = [(n, spark_hash(g, t), t) for t, n in votes[g].items() if t in fits]
                if not fits:
                    left.append(g)
                else:
                    asked.setdefault(max(voted)[2] if voted else fits[spark_hash(g, r) % len(fits)], []).append(g)
            waiting, now = [], list(room)
            for t, groups in asked.items():
                wanted = sum(size[g] for g in groups)
                share = min(1.0, 1.25 * now[t] / wanted) if wanted > now[t] else 1.0
                by_bucket = {}
                for g in groups:
                    by_bucket.setdefault(math.floor(spark_hash(g, r, "accept") % (1 << 32) / float(1 << 32) / share * buckets), []).append(g)
                full = False
                for b in sorted(by_bucket):
                    full = full or (wanted > now[t] and (b >= buckets or sum(size[g] for g in by_bucket[b]) > room[t]))
                    for g in by_bucket[b]:
                        if full:
                            waiting.append(g)
                        else:
                            labels[g] = t
                            room[t] -= size[g]
            r += 1
            if not waiting:
                break
        for g in sorted(left, key=lambda g: (-size[g], g)):
            rest, spread[g] = size[g], []
            while rest:
                fits = [t for t, x in enumerate(room) if x >= rest]
                t = min(fits, key=lambda t: (room[t], -votes[g].get(t, 0), t)) if fits else max(range(len(room)), key=lambda t: (room[t], votes[g].get(t, 0), -t))
                spread[g].append((t, min(rest, room[t])))
                room[t] -= spread[g][-1][1]
                rest -= spread[g][-1][1]
    return labels, spread


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_place_groups_as_the_plain_rounds_do(spark, seed):
    r = random.Random(seed)
    shards = r.choice([3, 6, 9])
    votes = {f"g{i}": {t: r.randint(1, r.choice([1, 4, 30])) for t in r.sample(range(shards), r.randint(1, 3))} for i in range(150)}
    total = sum(sum(v.values()) for v in votes.values()) + r.choice([0, 5, 200])
    quotas = [total // shards + (t < total % shards) for t in range(shards)]
    held = spark.createDataFrame([(g, t, n) for g, v in votes.items() for t, n in v.items()], "grp string, shard int, n bigint")
    large, small, spread = sharding.propagate(held, quotas)
    labels, pieces = plain_propagation(votes, quotas)
    got = {x["grp"]: x["label"] for x in large.unionByName(small).collect()}
    assert got == labels and spread == pieces and len(got) + len(spread) == sum(sum(v.values()) > 1 for v in votes.values())
    assert large.count() <= 16 * 2 * shards


def test_propagation_runs_on_every_table(spark):
    """The groups of a small table go through the rounds, and hardly any is spread."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = docs.count()
    start = F.pmod(F.xxhash64("doc_id"), F.lit(40)).cast("int")
    held = sharding.describe(docs).groupBy("grp", start.alias("shard")).agg(F.count("*").alias("n"))
    large, small, spread = sharding.propagate(held, [n // 40 + (t < n % 40) for t in range(40)])
    groups = held.groupBy("grp").agg(F.sum("n").alias("size")).filter("size > 1").count()
    assert large.count() + small.count() == groups - len(spread) > 20 and len(spread) <= 2


def toxic_rows():
    r = random.Random(4)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(clean) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for k in range(r.choice([2, 6])):
                words[k * 7] = r.choice(["vilea", "vileb", "vilec", "nasty"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_grades(spark, docs_of):
    rows, labels = toxic_rows()
    model = toxicity.train(docs_of(rows), spark.createDataFrame([*labels, (None, 1), (7, None), (99_999, 1)], "doc_id bigint, toxic int"))
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    extra = [*AWKWARD, (900, "plain words vilexyz vilea nasty vileb nasty vilec", "en", "s")]
    got = {(r["doc_id"], r["toxic"]): r["severity"] for r in toxicity.grade_documents(docs_of(rows[200:]).unionByName(docs_of(extra)), model).collect()}
    assert all((i, bool(y)) in got for i, y in labels[200:]) and (900, True) in got and (5, False) in got
    assert all(0 <= s <= 2 for s in got.values())
    kept = toxicity.reject_toxic(docs_of(rows), model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, y in labels if not y} and kept.columns == docs_of(rows).columns
    none = toxicity.train(docs_of(rows), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.grade_documents(docs_of(AWKWARD), none).filter("toxic or severity <> 0").count() == 0


def test_toxicity_of_documents_not_trained_on(spark, docs_of):
    rows, labels = toxic_rows()
    model = toxicity.train(docs_of(rows[:300]), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.grade_documents(docs_of(rows[300:]), model).collect()}
    assert len(got) == 100 and sum(got[i] == bool(y) for i, y in labels[300:]) >= 98


def plain_likelihood(params, row, col, grade, n_features):
    w, raw = params[:n_features], params[n_features:]
    t = [raw[0] + sum(math.exp(x) for x in raw[1 : k + 1]) for k in range(len(raw))]
    total = 0.0
    for i, g in enumerate(grade):
        s = sum(w[c] for r, c in zip(row, col) if r == i)
        above = [1.0, *(1 / (1 + math.exp(x - s)) for x in t), 0.0]
        total -= math.log(above[g] - above[g + 1]) / len(grade)
    return total + toxicity.RIDGE / 2 * sum(x * x for x in w)


def test_the_fit_is_a_minimum_of_the_likelihood():
    r = random.Random(8)
    grade = [r.randrange(3) for _ in range(40)]
    cells = sorted({(i, min(4, max(0, g + r.choice([0, 0, 1, 2])))) for i, g in enumerate(grade) for _ in range(2)})
    row, col = np.array([a for a, _ in cells]), np.array([b for _, b in cells])
    w, t = toxicity.fit_ordinal(row, col, np.array(grade), 5)
    at = [*w, t[0], math.log(t[1] - t[0])]
    best = plain_likelihood(at, row, col, grade, 5)
    for k in range(len(at)):  # the numerical gradient vanishes
        low, high = at.copy(), at.copy()
        low[k] -= 1e-4
        high[k] += 1e-4
        assert abs(plain_likelihood(high, row, col, grade, 5) - plain_likelihood(low, row, col, grade, 5)) / 2e-4 < 5e-3
    assert best < plain_likelihood([0.0] * 5 + [0.0, 0.0], row, col, grade, 5)


def test_severity_by_hand(spark, docs_of):
    model = toxicity.OrdinalModel({b"bad ": 2.0, b"vile": 1.5, b"fine ": -1.0}, [0.5, 2.0])
    got = {r["doc_id"]: r for r in toxicity.grade_documents(docs_of([(1, "Bad, fine vileness", "en", "s"), (2, None, "en", "s")]), model).collect()}
    p = [1 / (1 + math.exp(t - 2.5)) for t in (0.5, 2.0)]
    assert got[1]["severity"] == pytest.approx(sum(p)) and (got[1]["grade"], got[1]["toxic"]) == (2, True)
    assert got[2]["severity"] == pytest.approx(sum(1 / (1 + math.exp(t)) for t in (0.5, 2.0))) and got[2]["grade"] == 0


def test_shared_weights_are_ordered():
    row, col, grade = np.arange(90), np.repeat([0, 1, 2], 30), np.repeat([0, 1, 2], 30)
    w, t = toxicity.fit_ordinal(row, col, grade, 3)
    assert w[0] < w[1] < w[2] and t[0] < t[1]


def test_boosting_learns_a_threshold():
    x = np.random.default_rng(1).random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    assert ((boost.fit(x, y, trees=20, depth=3).log_odds(x) > 0) == (y > 0)).mean() > 0.97


def test_html_texts_of_unseen_pages():
    pages = generated_pages(60, seed=77)
    pages += [p for p in generated_pages(600, seed=79) if p.count("<p") > 80][:5]  # more siblings than most
    right = 0
    for page in pages:
        nodes = dom.annotate(dom.parse(page))
        truth = html_extract.wanted_nodes(nodes)
        want = [n.text() for n in nodes if truth[n.order] and n.runs and n.text()]
        right += html_extract.main_texts([page], html_extract.model())[0] == "\n".join(want)
    assert len(pages) >= 63 and right >= len(pages) - 3


def test_decoding_is_the_best_of_all_closed_sets():
    r = random.Random(6)
    for _ in range(40):
        html = "".join(r.choice(["<div>", "</div>", "<p>a", "x", "<li>b"]) for _ in range(9))
        nodes = dom.annotate(dom.parse(html))
        if len(nodes) > 9:
            continue
        odds = np.array([r.uniform(-2, 2) for _ in nodes])
        up = [n.parent.order if n.parent else None for n in nodes]
        closed = [k for k in range(1 << len(nodes)) if all(not k >> i & 1 or u is None or k >> u & 1 for i, u in enumerate(up))]
        best = max(closed, key=lambda k: sum(odds[i] for i in range(len(nodes)) if k >> i & 1))
        assert html_extract.kept_blocks(nodes, odds) == [n.text() for n in nodes if best >> n.order & 1 and n.runs and n.text()]


AWKWARD_MARKUP = [
    "<a " + '"' * 10_000, "<a " + "'" * 10_000, "<a " * 50_000, "<div>" * 30_000 + "x", "<b>" * 30_000 + "</i>" * 30_000, "<b><p>" + "<i>" * 30_000 + "</b>" * 30_000,
    "<!" * 50_000, "<!--" * 50_000, "<script>" + "</script " * 30_000, "<b>" * 30_000 + "<p>x</p>" * 30_000, "<" * 50_000, "<div>" * 10_000 + "</section>" * 30_000, "<p a=" * 20_000,
]


@pytest.mark.parametrize("k", range(len(AWKWARD_MARKUP)))
def test_reading_is_linear(k):
    import time

    start = time.process_time()
    dom.parse(AWKWARD_MARKUP[k])
    assert time.process_time() - start < 3


def test_malformed_attributes(spark):
    body = "<p>This is a paragraph, which is long enough. It has two sentences.</p>"
    pages = [f"<article {a}>{body}</article>" for a in ['data-truth="x"', "data-truth", 'data-truth="" class', "class='a>b' id=", 'title="a > b"', "= =/ a==b", 'x="1" x="2"', "class=post/"]]
    df = spark.createDataFrame([(i, p, "old", 1) for i, p in enumerate(pages)], "page_id bigint, html string, text string, n_chars int").withColumn("url", F.lit(None).cast("string"))
    got = html_extract.extract_text(df).collect()
    assert len(got) == len(pages) and {r["text"] for r in got} == {"This is a paragraph, which is long enough. It has two sentences."}
    assert dom.parse('<p title="never closed>one</p> two').children[0].text() == "one"
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_html_markup(spark):
    page = '<body><nav><a href="/">Home</a></nav><article class="post"><h1>A &amp; B</h1><p>First&nbsp;one\n two.<p><b>Second <i>one</i> here.<br>More.</p><script>var t="</p>"</script><!-- <p>no</p> --><p>Third, which is long enough to be prose.</article><footer>&copy; x</footer>'
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p>" * 3000, 5)], "page_id bigint, url string, html string, n_chars int")
    got = {r["page_id"]: r for r in html_extract.extract_text(df).collect()}
    assert got[1]["text"] == "A & B\nFirst one two.\nSecond one here. More.\nThird, which is long enough to be prose."
    assert got[1]["n_chars"] == len(got[1]["text"]) and [got[i]["text"] for i in (2, 3, 4)] == ["", "", ""]


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, sizes = docs, []
    for name, stage in p.STAGES:
        before = now
        now = stage(spark, now, sf_dir).cache()
        sizes.append(now.count())
        if name != "sharding":
            assert now.columns == docs.columns
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert now.join(before, "doc_id", "left_anti").count() == 0
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1")
    first = p.STAGES[0][1](spark, docs, sf_dir)
    assert first.join(toxic, "doc_id").count() == 0 and sizes[0] >= 0.8 * docs.count()
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("stage-*"))
    assert sizes[4] == sizes[3] and p.run(spark, sf_dir).count() == sizes[4]
    assert [f.name.split("-")[1] for f in set(shared.glob("stage-*")) - before] == ["sharding"]  # only the result is left of the stages


def test_pipeline_drops_pairs_from_80_per_cent(spark, docs_of, sf_dir):
    import corpus_pipeline as p

    def pair(i, n):  # one word of n + 4 is changed: 5 of n shingles differ on each side
        words = [f"w{i}_{k}" for k in range(n + 4)]
        return [(i, " ".join(words), "en", "s"), (i + 1, " ".join([*words[:20], "other", *words[21:]]), "en", "s")]

    rows = pair(10, 45) + pair(20, 50) + pair(30, 60) + pair(40, 40)  # Jaccard 0.800, 0.818, 0.846, 0.778
    kept = dict(p.STAGES)["near_duplicates"](spark, docs_of(rows), sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [10, 20, 30, 40, 41]


def test_stages_stand_awkward_rows(spark, docs_of, sf_dir):
    import corpus_pipeline as p

    rows = [*AWKWARD, (7, "a b c d e f g", "en", "s"), (7, "other text under the same id here", "en", "s"), (3, "A b c d e f g", "en", "s"), (None, "no id at all", "en", "s"), (None, None, None, None)]
    docs = docs_of(rows).withColumn("_row", F.lit(1)).withColumn("content", F.lit("c")).withColumn("grp", F.lit("g"))
    for name, stage in p.STAGES:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns + ["shard", "slot"] * (name == "sharding")
        texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
        every = sorted((i or 0, t or "") for i, t, _, _ in rows)
        if name == "near_duplicates":
            assert texts == sorted(set(every) - {(6, "same text here"), (7, "a b c d e f g")} | {(0, "no id at all")})
        elif name == "mixing":
            assert set(texts) <= set(every)
        else:
            assert texts == every
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_whole_pipeline_against_plain_stages(spark, sf_dir):
    """Every stage's rows over the whole table, worked out again without its operator."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    now, before = docs, None
    for name, stage in p.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        now = stage(spark, now, sf_dir).cache()
        got = now.collect()
        ids = {r["doc_id"] for r in got}
        if name == "toxicity":
            known = [i for i in before if toxic.get(i) is not None]
            assert sum((i not in ids) == bool(toxic[i]) for i in known) >= 0.98 * len(known)
        elif name == "near_duplicates":
            words = {i: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower()) for i, r in before.items()}
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0)} for i, w in words.items()}
            order = sorted(before)
            edges = [(a, b) for b in range(len(order)) for a in range(b) if (x := sets[order[a]]) and (y := sets[order[b]]) and 100 * len(x & y) >= 80 * len(x | y)]
            assert ids == {order[c] for c in plain_components(len(order), edges)}
        elif name == "decontamination":
            windows = {tuple(w[k : k + 10]) for _, t in items if (w := [x.decode() for x in decontam.words_of(t)]) for k in range(max(1, len(w) - 9))}
            text = lambda r: " " + " ".join(x.decode() for x in decontam.words_of(r["text"])) + " "
            assert ids == {i for i, r in before.items() if not any(f" {' '.join(w)} " in text(r) for w in windows)}
        elif name == "mixing":
            n = {i: sum(r["doc_id"] == i for r in got) for i in ids}
            copies = {r["doc_id"]: r["n_copies"] for r in mixing.mix(spark.createDataFrame(list(before.values()), docs.schema)).collect()}
            assert n == copies and all(tuple(r) == tuple(before[r["doc_id"]]) for r in got)
        else:
            sizes = [sum(r["shard"] == t for r in got) for t in range(40)]
            assert max(sizes) - min(sizes) <= 1 and sorted((r["shard"], r["slot"]) for r in got) == [(t, k) for t in range(40) for k in range(sizes[t])]
