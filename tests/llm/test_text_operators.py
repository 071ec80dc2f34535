"""Fill-in-the-middle, license scan and phrase collocations against plain versions and DuckDB."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import oracle
import pytest
from awkward import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st

from stanzaflow.llm import collocations, infill, licenses, queries

SIGNS = st.lists(st.sampled_from(["ab", "C", " ", "\n", "é", "1", "\U0001f600", "<", "<P", "<P>", "<S>", "<M", ">", "\r", "\x00", "Zz"]), max_size=30).map("".join)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_license_scan", "op13_collocations"])
def test_matches_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLE_SQL[name]) is None


@settings(max_examples=400, deadline=None)
@given(doc_id=st.integers(-5, 5000), text=SIGNS)
def test_cuts_and_round_trip(doc_id, text):
    n, form, prefix, middle, out = infill.rearranged(str(doc_id), text)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    assert n == len(units) and infill.restored(out, form) == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        assert (form, prefix, middle, out) == ("plain", None, None, text)
        return
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, z = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    assert (prefix, middle) == (len(a), len(b)) and form == ("spm" if h[3] % 100 < 20 else "psm")
    assert out == (f"<S>{z}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{z}<M>{b}")


def test_markers_that_could_be_mistaken_are_refused(spark, docs_of):
    for markers in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs_of(AWKWARD), markers=markers)


def test_fill_in_middle_table(spark, docs_of):
    rows = [*AWKWARD, (None, "text without an id", "en", "a"), (8, "has <S> inside", "en", "a")]
    got = infill.with_digests(infill.fill_in_middle(docs_of(rows).withColumnRenamed("kept", "form"))).collect()
    assert got[0].__fields__ == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = sorted((i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["restored_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[1]["n"], by_id[1]["form"], by_id[8]["form"], by_id[8]["middle_chars"]) == (0, "plain", "plain", None)
    assert infill.fill_in_middle(docs_of([])).count() == 0


def plain_matches(words, templates, step):
    """All blocks against all templates, without order or filters."""
    out = []
    for start in range(0, len(words), step):
        block = words[start : start + 2 * step]
        for t in templates:
            own = licenses.words_of(t.text)
            common = len(set(own) & set(block))
            places = [start + p for p in range(min(step, len(block) - len(own) + 1)) if t.phrase and block[p : p + len(own)] == own]
            if 100 * common >= t.percent * len(set(own)) and (places or not t.phrase):
                out.append((t.label, t.phrase, start, len(block), common, places))
    return sorted(out)


WORDS = ["a", "b", "c", "d", "e", "f", "x1", "x2", "x3", "x4"]
SOME = st.lists(st.sampled_from(WORDS), min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=60), st.lists(st.tuples(SOME, st.integers(1, 100), st.booleans()), min_size=1, max_size=5), st.lists(st.integers(0, 9), min_size=10, max_size=10), st.integers(1, 9))
def test_the_join_finds_what_all_pairs_find(words, told, counts, step):
    templates = [licenses.Template(f"t{k}", " ".join(w), 100 if phrase else percent, phrase) for k, (w, percent, phrase) in enumerate(told)]
    joiner = licenses.Joiner(templates, dict(zip((w.encode() for w in WORDS), counts)), step)
    words = [w.encode() for w in words]
    got = sorted((templates[t].label, templates[t].phrase, first, n, common, places) for t, first, n, common, places in joiner.matches(words))
    assert got == plain_matches(words, templates, joiner.step)


def test_license_table(spark, docs_of):
    filler = " ".join(f"w{i}" for i in range(70))
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    rows = [
        (20, f"{filler} Released under the MIT-License. {filler} General Public\nLicense, apache license mit license", "en", "a"),
        (21, f"{filler} {notice} {filler}", "en", "a"),
        (22, "license mit apache the license public general", "en", "a"),
        (23, "Licensed under CC BY-NC 4.0.", "en", "a"),
        (23, "mit élicense", "en", "a"),
    ]
    found = licenses.scan(docs_of([*AWKWARD, *rows]))
    got = licenses.license_digest(found).collect()
    by = {(r["doc_id"], r["n_words"]): r.asDict() for r in got}
    assert len(got) == len(AWKWARD) + len(rows)
    digest = {k: tuple(v[c] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")) for k, v in by.items()}
    assert digest[20, 152] == (4, 73, 150, "apache,gpl,mit", "apache,gpl,mit", 1.0)
    assert digest[21, 167][:5] == (0, None, None, "", "mit") and 0.8 <= digest[21, 167][5] <= 1
    assert digest[22, 7] == (0, None, None, "", "", 0.0) and digest[23, 7][4:] == ("cc-by-nc", 1.0) and digest[23, 2][4] == ""
    assert digest[1, 0] == digest[2, 0] == digest[3, 0] == (0, None, None, "", "", 0.0) and digest[4, 30_000][0] == 0
    match = found.filter("doc_id = 21").first()["matches"][0]
    assert match["label"] == "mit" and match["first"] <= 70 < match["first"] + match["length"]
    assert licenses.scan(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs_of([]), [licenses.Template("x", "--")])


def plain_collocations(rows, support, cover, top):
    out, by_lang = [], {}
    for lang, text in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            by_lang.setdefault(lang or "und", []).append([w for w in re.split("[ \t]+", piece) if w])
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        cands = {g: a for g, a in f.items() if len(g) > 1 and a >= support}
        kept = []
        for g, a in cands.items():
            if any(len(h) > len(g) and 100 * b >= cover * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in cands.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_collocations_equal_a_plain_count(spark, docs_of, seed):
    # many chunks in a task, hot pivots dealt over tasks, blocks that end within a route
    sizes = collocations.Sizes() if seed == 3 else collocations.Sizes(chunk=40, segment=30, hot=20, block=7)
    r = random.Random(seed)
    words = ["the", "of", "a", "New", "york", "x" * 300, "é", "İx", "stock", "market", "\U0001f600", "q\x00", "and"]
    texts = ["".join(r.choice(words[: r.choice([2, 5, 13])]) + r.choice([" ", " ", " ", "\t ", ". ", "\n", "\r", ",", "\x0b"]) for _ in range(r.randrange(0, 60))) for _ in range(60)]
    rows = [(i, t, r.choice(["en", "en", "de", None]), "a") for i, t in enumerate(texts)] + [(90, None, "en", "a"), (91, " ,.\n", "fr", "a")]
    got = collocations.collocations(docs_of(rows).withColumnRenamed("kept", "word"), 4, 50, 25, sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(x) for x in got.collect()) == plain_collocations([(x[2], x[1]) for x in rows], 4, 50, 25)


def test_collocations_of_awkward_rows(spark, docs_of):
    assert collocations.collocations(docs_of([])).count() == 0 and collocations.collocations(docs_of(AWKWARD)).count() == 0
    same = [(1, "tick tick tick tick " * 40, "en", "a")] * 3
    assert sorted(tuple(x) for x in collocations.collocations(docs_of(same)).collect()) == plain_collocations([(x[2], x[1]) for x in same], 10, 50, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 999_999_999_937, 1_000_000_000_039, 1_000_000_000_061
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert df.select(collocations._score(df.a, df.l, df.r)).first()[0] == 1_000_000 * a * a // (left * right)


def test_fragments_hold_what_the_pivot_owns():
    order = np.array([-1, 2, 0, 1, -1])  # code 2 is rarest, then 3, then 1; 4 is below the support
    got, n = collocations.fragments(np.array([1, 1, 2, 3, 2, 4, 1, 3, 0, 1], np.int32), order)
    assert {tuple(map(int, f)): int(k) for f, k in zip(got, n)} == {(0, 0, 1, 1, 0): 1, (1, 1, 2, 3, 2): 1, (0, 3, 2, 0, 0): 1, (0, 1, 3, 0, 0): 1}
