"""Token counts, token files, decontamination and language identification against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from awkward import AWKWARD, LONG
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stanzaflow.llm import decontam, langid, token_count, token_output
from stanzaflow.llm.common import first_by_hash

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = st.lists(st.sampled_from(list(" \n\t▁ab.,éÜ日x\x00<s>0A　ingthe") + ["\U0001f600", "İ", "J̌", "Σ", "ς", "'s", "<|endoftext|>", "\xa0", "\x1c", "²", "×", "Éé", "<|ENDOFTEXT|>"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return token_count.PieceCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None)
@given(text=ODD)
def test_counts_are_the_librarys(pieces, text):
    counter, library = pieces
    assert counter.count(text) == len(library.encode(text))


def test_merging_follows_rank_then_place():
    rank = {"ab": 2.0, "bc": 1.0, "aa": 1.0}
    assert token_count.merge_count("abc", rank, lambda c: 1) == 2  # bc first, and no piece a+bc
    assert token_count.merge_count("abc", rank | {"abc": 3.0}, lambda c: 1) == 1
    assert token_count.merge_count("aaa", rank, lambda c: 1) == 2
    assert token_count.merge_count("xé", {}, lambda c: len(c.encode())) == 3


def test_count_table(spark, docs_of, pieces):
    got = token_count.count_tokens(docs_of(AWKWARD), limit=100).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[1]["n_tokens"], by_id[2]["n_tokens"], by_id[2]["n_bytes"]) == (0, 0, 0)
    assert by_id[4]["n_tokens"] == len(pieces[1].encode(LONG)) and by_id[4]["over_limit"] and not by_id[5]["over_limit"]
    assert token_count.count_tokens(docs_of([])).count() == 0


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return token_output.TextEncoder(WORDS), Tokenizer.from_file(WORDS)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(ODD, max_size=4))
def test_ids_are_the_librarys(encoder, texts):
    own, library = encoder
    assert own.by_word
    for text, ids in zip(texts, own.encode(pa.array(texts, pa.string()))):
        assert np.frombuffer(ids, own.kind).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_coding_round_trip(numbers):
    values = np.array(numbers, np.uint32)
    control, data = token_output.pack(values)
    assert (token_output.unpack(control, data, len(values)) == values).all() and len(control) == -(-len(values) // 4)


def test_token_files(spark, docs_of, encoder):
    got = token_output.token_files(docs_of(AWKWARD)).orderBy("start").collect()
    at = 0
    texts = sorted((i, t or "") for i, t, _, _ in AWKWARD)
    assert [r["doc_id"] for r in got] == [i for i, _ in texts]
    for r, (_, text) in zip(got, texts):
        ids = [*encoder[1].encode(text, add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_output.token_files(docs_of([])).count() == 0


def plain_contamination(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(name))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in windows:
                    found |= windows[tuple(w[a : a + size])]
                    hit.update(range(a, a + size))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc ", max_size=60), max_size=6), st.lists(st.text("abc ", max_size=30), min_size=1, max_size=5), st.integers(1, 4))
def test_index_finds_what_a_scan_finds(texts, items, width):
    windows = decontam.Windows([(str(k), t) for k, t in enumerate(items)], width)
    got = decontam._shard_hits([decontam.words_of(t) for t in texts], windows)
    mine = sorted(((i, len(decontam.words_of(t)), sum(b - a for a, b in s), len(f), decontam.items_digest(list(f)), bool(f)) for i, (t, (s, f)) in enumerate(zip(texts, got))), key=repr)
    assert mine == plain_contamination(list(enumerate(texts)), list(enumerate(items)), width)


def test_decontamination_table(spark, docs_of, monkeypatch):
    items = [(10, "One two three four five six seven eight nine ten eleven"), (9, "short ITEM"), (8, None), (7, "..."), (10, "short item")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    text = "x " * 50 + "one, two three four five six seven eight nine TEN eleven " + "y " * 20 + "short-item"
    rows = [*AWKWARD, (11, text, "en", "a"), (12, "one two three", "en", "a")]
    want = plain_contamination([(i, t) for i, t, _, _ in rows], items)
    for size in (decontam.BLOCK_BYTES, 40):  # in one broadcast, and in several blocks
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = decontam.contamination_digest(decontam.find_contamination(docs_of(rows), bench)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    kept = decontam.clean_only(docs_of(rows), bench)
    assert kept.columns == docs_of(rows).columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 6, 12}
    assert decontam.clean_only(docs_of(rows), bench.limit(0)).count() == len(rows)
    assert decontam.find_contamination(docs_of([]), bench).count() == 0


def test_profiles_by_hand():
    grams, counts = langid.ngrams("Ab, a")
    name = lambda g: "".join(chr((g >> s) & 0x1FFFFF) for s in (42, 21, 0) if (g >> s) & 0x1FFFFF)
    assert {name(int(g)): int(n) for g, n in zip(grams, counts)} == {"a": 2, "b": 1, " a": 2, "ab": 1, "b ": 1, "a ": 1, " ab": 1, "ab ": 1, " a ": 1}
    table = langid.Profiles({"x": np.array([5, 7, 9]), "y": np.array([9, 7, 5])}, size=3)
    assert table.langs == ["x", "y"]


def plain_distance(text, profiles, size):
    """The nearest profile and the score, straight from the definition."""
    c = "".join(x if x.isalpha() else " " for x in f" {text} ".lower())
    c = re.sub(" +", " ", c)
    grams = [c[i : i + n] for n in (1, 2, 3) for i in range(len(c) - n + 1)]
    grams = [g for g in grams if g != " " and not (len(g) == 3 and g[1] == " ")]
    number = lambda g: int("".join(f"{ord(x):021b}" for x in g), 2)
    own = sorted(set(grams), key=lambda g: (-grams.count(g), number(g)))[:size]
    off = {lang: sum(min(abs(p.index(g) - i), size) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(off), key=off.get)
    return best, 1 - off[best] / (size * len(own))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé X.1", max_size=30), min_size=2, max_size=2), st.text("abcé X.1", max_size=40))
def test_out_of_place_distance(learned, text):
    size = 12
    names = [langid.top(*langid.ngrams(t), size) for t in learned]
    text_of = lambda g: "".join(chr((int(g) >> s) & 0x1FFFFF) for s in (42, 21, 0) if (int(g) >> s) & 0x1FFFFF)
    table = langid.Profiles({f"l{k}": n for k, n in enumerate(names)}, size)
    got = table.predict(text)
    if not any(c.isalpha() for c in text) or not any(map(len, names)):
        assert got == ("und", 0.0)
    else:
        want = plain_distance(text, {f"l{k}": [text_of(g) for g in n] for k, n in enumerate(names) if len(n)}, size)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-12


def test_the_sample_is_the_first_by_hash(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(3000)] + [(-1, "c")], "doc_id bigint, g string")
    got = {g: {r["doc_id"] for r in first_by_hash(rows, "g", 160).filter(F.col("g") == g).collect()} for g in "abc"}
    hashed = rows.select("doc_id", "g", F.xxhash64("doc_id").alias("h"), F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(16)).alias("p")).collect()
    first = {g: [r["doc_id"] for p in range(16) for r in sorted((r for r in hashed if (r["g"], r["p"]) == (g, p)), key=lambda r: r["h"])[:10]] for g in "abc"}
    assert got["c"] == {-1} and all(got[g] <= set(first[g]) and 140 <= len(got[g]) <= 160 for g in "ab")


def test_memos_are_bounded_in_bytes(monkeypatch, pieces, encoder):
    monkeypatch.setattr(token_count, "MEMO_BYTES", 2000)
    monkeypatch.setattr(token_output, "MEMO_BYTES", 2000)
    text = " ".join(f"w{i}" for i in range(300)) + " " + "z" * 500
    counter, writer = token_count.PieceCounter(MODEL), token_output.TextEncoder(WORDS)
    assert counter.count(text) == len(pieces[1].encode(text)) and counter.words.held <= 2000 and max(map(len, counter.words)) <= 64
    for _ in range(2):
        assert np.frombuffer(writer.encode(pa.array([text]))[0], writer.kind).tolist() == encoder[1].encode(text, add_special_tokens=False).ids
    assert max(map(len, writer.memo)) <= 64


def test_language_table(spark, docs_of):
    rows = [(i, ("the and of with that this " if i % 2 else "der und die nicht durch ein ") * 5, "en" if i % 2 else "de", "s") for i in range(100, 160)]
    got = {r["doc_id"]: r for r in langid.identify(docs_of([*rows, *AWKWARD, (7, "1234 !!", "en", "a")])).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 7)] == ["und"] * 4 and got[7]["score"] == 0.0
    none = langid.identify(docs_of(rows).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"} and langid.identify(docs_of([])).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = both.filter("lang = lang_pred").count(), both.count()
    assert n > 20 and right / n >= 0.95
