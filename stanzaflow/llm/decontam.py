"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a run of whole documents of one input partition.  Its words become numbers; words that
no benchmark item holds can be part of no match, so each stretch of them is one border symbol, and
stretches of known words shorter than the shortest window are left out.  Over the rest stand a suffix
array, its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions.  All windows
of the benchmark are searched backwards at once; occurrences are located by stepping to sampled
positions, and overlapping occurrences are merged into removal spans.

The benchmark is held in blocks of bounded size.  Each has a pass of its own over the documents, whose hits are stored, so
its size isn't limited and a worker holds one block.

Defined cases: a null or wordless document has no words and is clean; a null or wordless item has no
window; items with equal ids count as one; windows shared by items count for each; a document is
searched whole whatever its length; repeated rows and repeated ids are searched each, and a null doc_id is kept; an empty
benchmark leaves all documents clean; an empty table gives an empty result; extra columns of either table are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

WINDOW = 10
SHARD_BYTES = 2 << 20  # text of a shard; a longer document is a shard of its own
SAMPLE = 8  # every so many-th text position is kept with its suffix
BLOCK_BYTES = 16 << 20  # benchmark text in one broadcast

_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, lower-cased ASCII letters and non-ASCII characters."""
    return text.encode("utf-8").translate(_TO_WORDS).split() if text else []


# ---------------------------------------------------------------- the index

class Bits:
    """A packed row of bits with the ones before each word of 64, to count ones before many places at once."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits.astype(bool), bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32 if self.n < 1 << 31 else np.int64)
        self.total = int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Is the bit at each place set?"""
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many queries at once; one row of packed bits for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = len(symbols)
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []  # with the number of zeros
        seq = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            row = Bits(bit)
            self.levels.append((row, self.n - row.total))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the given place."""
        lo, hi = np.zeros_like(at), at.copy()
        for k, (row, zeros) in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = row.ones(lo), row.ones(hi)
            lo = np.where(bit, zeros + a, lo - a)
            hi = np.where(bit, zeros + b, hi - b)
        return hi - lo

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        lo, place, symbol = np.zeros_like(at), at.copy(), np.zeros_like(at)
        for row, zeros in self.levels:
            a, b, bit = row.ones(lo), row.ones(place), row.get(place)
            symbol = symbol * 2 + bit
            lo = np.where(bit, zeros + a, lo - a)
            place = np.where(bit, zeros + b, place - b)
        return symbol, place - lo


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling; each border (0) is a symbol of its own."""
    n = len(symbols)
    border = symbols == 0
    rank = symbols + np.int64(border.sum())
    rank[border] = np.arange(border.sum())
    width = 1
    while True:
        key = rank * np.int64(n + int(rank.max()) + 2)
        key[: max(0, n - width)] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Full-text index of a sequence of numbers; 0 is a border that no pattern crosses."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        order = suffix_order(symbols)
        self.n = n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.matrix = WaveletMatrix(symbols[order - 1], sigma)
        # positions are kept at every SAMPLE-th place and at each start of a stretch, so that no step crosses a border
        kept = (order % SAMPLE == 0) | (symbols[order - 1] == 0)
        self.kept = Bits(kept)
        self.at = order[kept].astype(np.int32 if n < 1 << 31 else np.int64)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns (a row each, all of one length), by backward search."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            lo[alive] = self.before[c] + self.matrix.rank(c, lo[alive])
            hi[alive] = self.before[c] + self.matrix.rank(c, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
            if not len(alive):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, stepping back to kept positions."""
        place, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            found = self.kept.get(rows[todo])
            done = todo[found]
            place[done] = self.at[self.kept.ones(rows[done])] + steps[done]
            todo = todo[~found]
            symbol, rank = self.matrix.symbol_and_rank(rows[todo])
            rows[todo] = self.before[symbol] + rank
            steps[todo] += 1
        return place


# ---------------------------------------------------------------- benchmark windows

class Windows:
    """The windows of a block of benchmark items, as numbers of the block's own words."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WINDOW):
        self.word_id: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.word_id.setdefault(w, len(self.word_id) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + width]), set()).add(name)
        lengths = sorted({len(w) for w in owners})
        self.groups = []  # (length, windows of that length, the item names of each)
        for length in lengths:
            own = [w for w in owners if len(w) == length]
            self.groups.append((length, np.array(own, np.int64).reshape(-1, length), [sorted(owners[w]) for w in own]))
        self.shortest = lengths[0] if lengths else 0


def _shard_hits(texts: list[list[bytes]], windows: Windows) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For each document's words: merged spans (first word, end word), and the items found."""
    hits: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
    if not windows.shortest:
        return hits
    pieces, doc_at, word_at = [], [], []
    for d, words in enumerate(texts):
        if len(words) < windows.shortest:
            continue
        ids = np.fromiter((windows.word_id.get(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]]).astype(np.int8)))
        for a, b in edge.reshape(-1, 2):
            if b - a >= windows.shortest:
                pieces += [ids[a:b], np.zeros(1, np.int64)]
                doc_at.append(np.full(b - a + 1, d))
                word_at.append(np.arange(a, b + 1))
    if not pieces:
        return hits
    symbols, doc_at, word_at = np.concatenate(pieces), np.concatenate(doc_at), np.concatenate(word_at)
    index = FMIndex(symbols, len(windows.word_id) + 1)
    change = np.zeros(len(symbols) + 1, np.int64)
    for length, patterns, owners in windows.groups:
        lo, hi = index.search(patterns)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            continue
        rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        place = index.locate(rows)
        np.add.at(change, place, 1)
        np.add.at(change, place + length, -1)
        for d, w in np.unique(np.stack([doc_at[place], which], 1), axis=0):
            hits[d][1].update(owners[w])
    covered = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8))).reshape(-1, 2)
    for a, b in edge:  # a span never covers a border, so it lies in one document
        hits[doc_at[a]][0].append((int(word_at[a]), int(word_at[a]) + int(b - a)))
    return hits


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# ---------------------------------------------------------------- on Spark

SCHEMA = "doc_id bigint, n_words bigint, items array<string>, spans array<struct<first:bigint,last:bigint>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _blocks(benchmark: DataFrame) -> list:
    """Broadcast variables of the benchmark's windows, each of bounded text size."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // (BLOCK_BYTES // 2)))
    spark = benchmark.sparkSession
    made = []
    for k in range(n):
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        made.append(spark.sparkContext.broadcast([(r[0], r[1]) for r in own.collect()]))
    return made


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, items, spans`` for each row of ``docs(doc_id, text)``.

    ``spans`` are merged ranges of word positions (first, and one past the last).  A narrow pass for each block of the
    benchmark, most often one: the documents aren't shuffled.  The index of a shard stands over the stretches of words
    that some benchmark item has; no window can lie outside them.
    """
    blocks = _blocks(benchmark)
    first = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_search(blocks[0], width), SCHEMA)
    if len(blocks) == 1:
        return first
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    hits = _hits(own, blocks, width).select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "items", "spans")
    counted = own.mapInArrow(_counted, "doc_id bigint, content bigint, n_words bigint")
    found = counted.join(hits, counted["doc_id"].eqNullSafe(hits["_id"]) & (F.col("content") == F.col("_content")), "left")
    empty = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("items", "spans")]
    return found.select("doc_id", "n_words", *empty)


def _search(block, width: int):
    """A function of Arrow batches ``doc_id, text`` that finds a block's windows."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, texts, items, spans in _searched(batches, 1, block, width):
            columns = [
                shard.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], _SPANS),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "items", "spans"])

    return searched


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = pa.array([len(words_of(t.as_py())) for t in batch.column(2)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "content", "n_words"])


def _hits(docs: DataFrame, blocks: list, width: int) -> DataFrame:
    """``doc_id, content, items, spans`` of the distinct documents that hold windows, over all blocks.

    A pass of its own for each block, whose hits are stored, so a worker holds one block at a time.
    """
    passes = []
    for block in blocks:

        def hit(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for shard, _, items, spans in _searched(batches, 2, block, width):
                rows = [k for k, i in enumerate(items) if i]
                part = shard.take(pa.array(rows, pa.int64()))
                lists = [pa.array([sorted(items[k]) for k in rows], pa.list_(pa.string())), pa.array([[{"first": a, "last": b} for a, b in spans[k]] for k in rows], _SPANS)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["doc_id", "content", "items", "spans"])

        passes.append(Stored(docs.mapInArrow(hit, "doc_id bigint, content bigint, items array<string>, spans array<struct<first:bigint,last:bigint>>").distinct(), "benchmark-hits").df)
        block.unpersist(True)
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    both = every.groupBy("doc_id", "content").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    start = F.slice("spans", 1, 1)

    def merged(acc, s):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))))
        return F.when(s["first"] <= last["last"], grown).otherwise(F.concat(acc, F.array(s)))

    return both.withColumn("spans", F.aggregate("spans", start, merged))


def _searched(batches: Iterator[pa.RecordBatch], text: int, block, width: int) -> Iterator[tuple]:
    """Shards of whole documents with their words, the items found in each, and the merged spans."""
    windows = Windows(block.value, width)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, size, start = [], 0, at
            while at < batch.num_rows and size < SHARD_BYTES:
                cell = batch.column(text)[at].as_py()
                texts.append(words_of(cell))
                size += len(cell or "")
                at += 1
            found = _shard_hits(texts, windows)
            yield batch.slice(start, at - start), texts, [i for _, i in found], [_merged(s) for s, _ in found]


def contamination_digest(found: DataFrame) -> DataFrame:
    """The counts and the item list's SHA-256 of what ``find_contamination`` gives."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_only(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their columns unchanged; a narrow pass for each block of the benchmark."""
    text = docs.columns.index("text")
    blocks = _blocks(benchmark)
    for k, block in enumerate(blocks):

        def cleaned(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for shard, _, items, _ in _searched(batches, text, block, width):
                yield shard.filter(pa.array([not i for i in items], pa.bool_()))

        docs = docs.mapInArrow(cleaned, docs.schema)
        if k + 1 < len(blocks):  # the next block starts from stored rows, so a worker holds one block at a time
            docs = Stored(docs, "clean-documents").df
    return docs


def items_digest(items: list[str]) -> str:
    """What ``items_sha256`` holds for a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
