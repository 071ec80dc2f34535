"""Phrase collocations by pivot partitioning, as in MG-FSM.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and the pieces into words.  An n-gram's pivot is its
rarest word (of equally rare ones the first in order of the words).  The steps, each a Spark job over all documents:

1. Chunks of texts of one language are stored in dictionary coding: their distinct words, counts and coded words.
2. The chunks' words are summed up to the frequency list.  Words with enough support are numbered by language, the most frequent first; the
   others are in no candidate.
3. Each chunk gets the numbers of its own words by a join, and is rewritten: for every place of a word, a fragment holds that word as
   pivot and the words up to two places away that belong to n-grams the pivot owns; rarer words are blanks and end the fragment.  Only the
   first place of a pivot in an n-gram counts, so left neighbours must be more frequent, right ones as frequent.  Equal fragments of a
   chunk are one row with a count.
4. Fragments are routed by pivot and mined there: sorted by pivot, the n-grams of some hundred thousand fragments at a time are counted
   with numpy, and only those with support go on.  The fragments of a pivot with more than ``Sizes.hot`` places are dealt over several tasks by their
   words, and so are counted once more.
5. Candidates are joined with the counts of their parts, scored, compared with the longer candidates around them, and ranked.

No words are broadcast and nothing but counts of tables comes to the driver; memory is bounded by a chunk and by a block of fragments.  Chunks,
frequency list and candidates are tables in the shared folder, so a lost executor costs its own tasks only.

Defined cases: a null text counts as empty, a null language as ``und``; texts without words add nothing; repeated rows count each; a language
with no candidate has no rows; ties are settled by count, then by the phrase in byte order; a text, piece or word of any length is taken
whole; an empty table gives an empty result; other columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import Stored, join_hot

SUPPORT = 10
COVER_PERCENT = 50  # of a candidate's count, from which on a longer candidate around it takes its place
TOP = 2000
RANK_PARTS = 64

@dataclass(frozen=True)
class Sizes:
    """What a task holds at once."""

    chunk: int = 1_000_000  # words of a chunk
    segment: int = 1 << 20  # bytes of a text that are cut into words at once, up to the next end of a piece
    hot: int = 1 << 20  # places of a pivot from which on it is dealt over several tasks
    block: int = 400_000  # fragments whose n-grams are counted at once; their words fit 21 bits each


#: Lower-cases A-Z, makes tabs blanks and ends of pieces line ends.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x09 else 0x0A if 0x0A <= b <= 0x0D or b in b".,;:!?" else b for b in range(256))


class _Codes(dict):
    """Numbers of words in order of their first place; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Texts of one language in dictionary coding."""

    def __init__(self):
        self.codes, self.parts, self.size = _Codes({b"\n": 0}), [], 0

    def add(self, segment: bytes) -> None:
        words = list(filter(None, (segment.replace(b"\n", b" \n ") + b" \n").split(b" ")))
        self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
        self.size += len(words)


def segments(text: str, size: int = Sizes.segment) -> Iterator[bytes]:
    """A folded text in stretches of whole pieces."""
    data, at = text.encode("utf-8").translate(_FOLD), 0
    while at < len(data):
        end = data.find(b"\n", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


CHUNK_SCHEMA = "chunk bigint, lang string, words array<string>, counts array<bigint>, codes binary, size bigint"
_CODEC = "zstd"


def _chunker(sizes: Sizes) -> Callable:
    """A function of Arrow batches ``lang, text`` that gives chunks; a task holds four of them at most."""

    def row(number: int, lang: str, chunk: Chunk) -> pa.RecordBatch:
        codes = np.concatenate(chunk.parts)
        words = pa.array(list(chunk.codes)[1:], pa.binary()).cast(pa.string())
        counts = pa.array(np.bincount(codes, minlength=len(chunk.codes))[1:].astype(np.int64))
        ends = pa.array([0, len(words)], pa.int32())
        packed = pa.compress(codes.tobytes(), _CODEC, asbytes=True)
        columns = [pa.array([number], pa.int64()), pa.array([lang]), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, counts), pa.array([packed]), pa.array([len(codes)])]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "lang", "words", "counts", "codes", "size"])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Chunk] = {}
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lang, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                for segment in segments(cell.as_py(), sizes.segment):
                    held.setdefault(lang, Chunk()).add(segment)
                    full = held[lang].size >= sizes.chunk
                    if not full and sum(c.size for c in held.values()) >= 4 * sizes.chunk:
                        full, lang_out = True, max(held, key=lambda k: (held[k].size, k))
                    else:
                        lang_out = lang
                    if full:
                        number += 1
                        yield row(number, lang_out, held.pop(lang_out))
        for lang in list(held):
            number += 1
            yield row(number, lang, held.pop(lang))

    return chunked


def fragments(codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fragments, as rows of five codes (two left, pivot, two right; 0 for none), and their counts.

    ``order`` tells each code's place from the rarest word up, -1 for the end of a piece and for words below the support.
    """
    padded = np.concatenate([np.zeros(2, np.int32), codes, np.zeros(2, np.int32)])
    at = 2 + np.flatnonzero(order[codes] >= 0)
    own = order[padded[at]]
    near = {d: padded[at + d] for d in (-2, -1, 1, 2)}
    keeps = {d: order[c] > own if d < 0 else order[c] >= own for d, c in near.items()}
    keeps[-2] &= keeps[-1]
    keeps[2] &= keeps[1]
    some = keeps[-1] | keeps[1]
    left2, left1, right1, right2 = (np.where(keeps[d], near[d], 0)[some].astype(np.int64) for d in (-2, -1, 1, 2))
    pivot, base = padded[at][some].astype(np.int64), np.int64(len(order))
    lefts, left = np.unique(left2 * base + left1, return_inverse=True)
    rights, right = np.unique(right1 * base + right2, return_inverse=True)
    sides, side = np.unique(left * len(rights) + right, return_inverse=True)
    keys, counts = np.unique(side * base + pivot, return_counts=True)
    side, pivot = np.divmod(keys, base)
    left, right = np.divmod(sides[side], len(rights)) if len(keys) else (side, side)
    return np.stack([lefts[left] // base, lefts[left] % base, pivot, rights[right] // base, rights[right] % base], axis=1), counts


FRAGMENT_SCHEMA = "route bigint, lefts bigint, rights bigint, n bigint"
_LOW = np.int64(0xFFFFFFFF)


def _rewriter(most: int) -> Callable:
    """A function of Arrow batches ``codes, size, known`` of chunks that gives their fragments; ``known`` are the indexes, numbers and frequencies of words with enough support.

    ``route`` holds the pivot's number and below it 0, or for a hot pivot a part from 1 on; ``lefts`` and ``rights`` hold two numbers
    each, the nearer one above; numbers count from 1.
    """

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                known, size = batch.column(2)[k].values, batch.column(1)[k].as_py()
                index, number, n = (known.field(f).to_numpy(zero_copy_only=False) for f in ("at", "number", "n"))
                top = int(index.max()) + 2
                codes = np.frombuffer(pa.decompress(batch.column(0)[k].as_py(), 4 * size, _CODEC, asbytes=True), np.int32)
                codes = np.where(codes < top, codes, 0) if len(codes) and codes.max() >= top else codes
                order, numbers, hot = np.full(top, -1, np.int64), np.zeros(top, np.int64), np.zeros(top, np.int64)
                order[index + 1] = number.max() - number  # the rarest has the greatest number
                numbers[index + 1] = number + 1
                hot[index + 1] = np.where(n > most, -(-n // most), 0)
                found, counts = fragments(codes, order)
                left2, left1, pivot, right1, right2 = numbers[found].T
                lefts, rights, parts = (left1 << 32) | left2, (right1 << 32) | right2, hot[found[:, 2]]
                spread = (lefts * np.int64(0x9E3779B97F4A7C1) ^ rights * np.int64(0x2545F4914F6CDD1D)) >> np.int64(20)
                route = (pivot << 32) | np.where(parts > 0, 1 + np.abs(spread) % np.maximum(parts, 1), 0)
                place = np.lexsort((rights, lefts, route))
                columns = [route, lefts, rights, counts]
                for a in range(0, len(place), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[place[a : a + 50_000]]) for c in columns], ["route", "lefts", "rights", "n"])

    return rewritten


def owned(pivot: np.ndarray, lefts: np.ndarray, rights: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams that hold the pivots of some fragments, as rows of three numbers (the third 0 in pairs), and their counts."""
    left1, left2, right1, right2 = lefts >> 32, lefts & _LOW, rights >> 32, rights & _LOW
    none = np.zeros_like(pivot)
    cases = [(left1, (left1, pivot, none)), (right1, (pivot, right1, none)), (left2, (left2, left1, pivot)), (np.minimum(left1, right1), (left1, pivot, right1)), (right2, (pivot, right1, right2))]
    ids = np.concatenate([[0], *(c for c in (pivot, left1, left2, right1, right2))])
    ids, code = np.unique(ids, return_inverse=True)
    base = np.int64(len(ids))
    where = np.split(code[1:], 5)
    of = {id(c): w for c, w in zip((pivot, left1, left2, right1, right2), where)} | {id(none): none}
    keys, weights = [], []
    for there, (a, b, c) in cases:
        rows = np.flatnonzero(there)
        keys.append((of[id(a)][rows] * base + of[id(b)][rows]) * base + of[id(c)][rows])
        weights.append(n[rows])
    key, weight = np.concatenate(keys), np.concatenate(weights)
    place = np.argsort(key, kind="stable")
    key, weight = key[place], weight[place]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else place
    sums = np.add.reduceat(weight, first) if len(key) else weight
    key = key[first]
    return np.stack([ids[key // base // base], ids[key // base % base], ids[key % base]], axis=1), sums


def _miner(support: int, block: int) -> Callable:
    """A function of Arrow batches ``route, lefts, rights, n``, sorted by route, that gives n-grams ``w1, w2, w3, n``.

    Fragments are taken in blocks; a block ends where a route ends, unless one has more than a block.  N-grams of a whole route that isn't a
    part of a hot pivot are complete, and leave if they lack support.
    """

    def counted(part: list[np.ndarray], whole: np.ndarray) -> Iterator[pa.RecordBatch]:
        for rows, complete in ((whole, True), (~whole, False)):
            if not rows.any():
                continue
            route, lefts, rights, n = (c[rows] for c in part)
            grams, sums = owned(route >> 32, lefts, rights, n)
            if complete:
                grams, sums = grams[sums >= support], sums[sums >= support]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in grams.T), pa.array(sums)], ["w1", "w2", "w3", "n"])

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, torn = 0, None  # torn: a route whose first fragments were counted in an earlier block
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            while rows >= block:
                columns = [np.concatenate(c) for c in zip(*held)]
                route = columns[0][:block]
                end = int(np.searchsorted(route, route[-1]))  # where the last route of the block begins
                cut = end or block
                whole = ((route[:cut] & _LOW) == 0) & (route[:cut] != (-1 if torn is None else torn)) & bool(end)
                yield from counted([c[:cut] for c in columns], whole)
                torn = None if end else int(route[-1])
                held = [[c[cut:] for c in columns]]
                rows -= cut
        if rows:
            columns = [np.concatenate(c) for c in zip(*held)]
            yield from counted(columns, ((columns[0] & _LOW) == 0) & (columns[0] != (-1 if torn is None else torn)))

    return mined


def mine(docs: DataFrame, support: int = SUPPORT, sizes: Sizes = Sizes()) -> tuple[Stored, DataFrame, DataFrame]:
    """Stored ``w1, w2, w3, a``, all n-grams of two (``w3`` 0) or three words, by number, with at least ``support`` places; the words with that
    support, ``number, lang, word, n``, stored too; and ``lang, n``, the words of each language."""
    texts = docs.filter("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    chunks = Stored(texts.mapInArrow(_chunker(sizes), CHUNK_SCHEMA), "collocation-chunks")
    counted = chunks.df.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    frequent = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)
    words = Stored(numbered(frequent, "lang", F.desc("n"), "word", name="number").withColumn("number", F.col("number") + 1), "collocation-words")
    each = F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y)
    totals = Stored(chunks.df.select("lang", each.alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "collocation-totals")  # a row for each language

    own = chunks.df.select("chunk", "lang", F.posexplode("words").alias("at", "word")).join(words.df, ["lang", "word"])
    known = own.groupBy("chunk").agg(F.collect_list(F.struct("at", (F.col("number") - 1).alias("number"), "n")).alias("known"))  # no more than a chunk's words
    rewritten = chunks.df.select("chunk", "codes", "size").join(known, "chunk").select("codes", "size", "known").mapInArrow(_rewriter(sizes.hot), FRAGMENT_SCHEMA)
    routed = rewritten.repartition("route").sortWithinPartitions("route")
    mined = routed.mapInArrow(_miner(support, sizes.block), "w1 bigint, w2 bigint, w3 bigint, n bigint")
    candidates = Stored(mined.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("a")).filter(F.col("a") >= support), "collocation-candidates")
    chunks.drop()
    return candidates, words.df, totals.df


def _score(a, left, right) -> F.Column:
    """floor(1000000 * a * a / (left * right)), in decimals of 38 digits."""
    a, left, right = (c.cast("decimal(18,0)") for c in (a, left, right))
    above, below = (F.lit(1_000_000).cast("decimal(7,0)") * a).cast("decimal(20,0)") * a.cast("decimal(18,0)"), left * right
    return F.call_function("div", above, below)


def collocations(docs: DataFrame, support: int = SUPPORT, cover: int = COVER_PERCENT, top: int = TOP, sizes: Sizes = Sizes()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two and three words of ``docs(lang, text)``."""
    candidates, words, totals = mine(docs, support, sizes)
    c = candidates.df
    # the texts and counts of the words; a common word is in many candidates
    each = c.select("w1", "w2", "w3", "a", F.posexplode(F.filter(F.array("w1", "w2", "w3"), lambda w: w > 0)).alias("at", "number"))
    often = each.groupBy("number").agg(F.count("*").alias("size"))
    told = join_hot(each, words, ["number"], "w2", often, often.agg(F.sum("size")).first()[0] or 0)
    told = told.groupBy("w1", "w2", "w3", "a").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.min_by("n", "at").alias("f_first"), F.max_by("n", "at").alias("f_last"),
    )
    two = told.filter("w3 = 0").select("lang", "w1", "w2", "w3", "phrase", "a", F.col("f_first").alias("l"), F.col("f_last").alias("r"), _score(F.col("a"), F.col("f_first"), F.col("f_last")).alias("score"))
    pairs, triples = c.filter("w3 = 0"), c.filter("w3 > 0")
    ahead = pairs.select("w1", "w2", F.col("a").alias("f_ahead"))
    behind = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f_behind"))
    three = told.filter("w3 > 0").join(ahead, ["w1", "w2"]).join(behind, ["w2", "w3"])
    first, second = _score(F.col("a"), F.col("f_first"), F.col("f_behind")), _score(F.col("a"), F.col("f_ahead"), F.col("f_last"))
    three = three.withColumn("one", first).withColumn("two", second)
    three = three.select(
        *("lang", "w1", "w2", "w3", "phrase", "a"),
        F.when(F.col("two") < F.col("one"), F.col("f_ahead")).otherwise(F.col("f_first")).alias("l"),
        F.when(F.col("two") < F.col("one"), F.col("f_last")).otherwise(F.col("f_behind")).alias("r"),
        F.least("one", "two").alias("score"),
    )
    # a pair gives way to a triple around it with enough of its places
    inside = F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
    around = triples.select("a", inside.alias("p")).select("p.*", "a").groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two = two.join(around, ["w1", "w2"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(cover) * F.col("a"))).drop("longer")

    every = two.select(*three.columns).unionByName(three).select("lang", "phrase", "a", "l", "r", "score")
    # the best of each hash part first, so no task sorts all candidates of a language
    best_first = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = F.row_number().over(W.partitionBy("lang", "_part").orderBy(*best_first))
    short = every.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("_place", place).filter(F.col("_place") <= top).drop("_part", "_place")
    best = short.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best_first))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
