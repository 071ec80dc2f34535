"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signature.  A shingle's hash gives its place on a ring of ``RING`` places (the first permutation); the
second permutation is a fixed table over the ring.  Coordinate k of the signature is the smallest table
value found k places further round from any of the document's shingles, so one shifted permutation
gives all coordinates.  ``BANDS`` bands of ``ROWS`` coordinates are hashed to buckets; a pair at the
threshold 0.85 shares no bucket with a probability of about 1e-8.

Documents with equal shingle sets are first folded into one class.  Within a bucket no list
of pairs is made: a pivot (the member met most often over all buckets) is compared with every member,
and a bucket whose members are then all in one component is done.

In the buckets left over, heavily edited copies meet that hardly ever link.  There a bound that no link
escapes decides which members of different components are compared: a link needs
common >= t / (1 + t) * (|x| + |y|), and x can share no shingle that no other member of an open bucket has.
So with c(x) = shingles of x that some other open document has, min(c(x), c(y), |x|, |y|) must reach that
size.  Documents with c(x) < t * |x| leave first.  Of the others the parities of ``PARITY`` parts of their sets are compared: each
part whose parities differ holds a shingle that only one of the two has, and a link allows no more than
(1 - t) / (1 + t) * (|x| + |y|) of those.  That tells apart the copies of one text that were edited at different places.
Members of a large bucket meet in blocks, a task for each pair of blocks.

Links are confirmed on the full sets of 64-bit shingle hashes.  Hot buckets, shingles and pivots are dealt over several tasks.

Defined cases: null texts and texts without words have an empty set, link with nothing and are kept;
fewer than five words make one shingle of the whole sequence; repeated rows and equal texts fall in
one component; rows that share a doc_id but not their set are classes of their own, each linked by its own text, and a
component's id is its smallest doc_id; rows without a doc_id link with nothing, have no component_id and are kept; a
document's length isn't limited; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, cut, join_hot, unused
from .graph import components

WORDS = 5
PERCENT = 85
BANDS, ROWS = 32, 5
RING = 1 << 20
TRIMS = 2  # times the open documents that can't link are dropped before pairs are made
PARITY = 1024  # bits, a multiple of 64
BLOCK = 256  # members of an open bucket that a task compares with as many others
BROADCAST_IDS = 1_000_000  # classes (32 bytes each) up to which they are broadcast to filter the documents
PIECE = 1 << 17  # bytes of text that are hashed at once
TEXTS_AT_ONCE = 512

#: ASCII letters in lower case, and one kind of white space.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if 0x09 <= b <= 0x0D else b for b in range(256))
_MULTIPLIERS = np.random.default_rng(20_240_501).integers(1 << 62, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_table: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _short_word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a piece: each byte's place in its word and its value are mixed, and the sums taken."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], b != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    size = end - first
    at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(first) else first
    place = (at - np.repeat(first, size)).astype(np.uint64)
    value = _mix((place << np.uint64(8)) + b[at] + np.uint64(0x9E3779B97F4A7C15))
    return first, np.add.reduceat(value, np.cumsum(size) - size) if len(first) else value


def _word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a long text, piece by piece; a word longer than a piece has another hash."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        last = max(data.rfind(b" ", at, end), at - 1) + 1  # the piece's last word
        long_word = end - last > PIECE
        out.append(_short_word_hashes(data[at : last if long_word else end])[1])
        if long_word:
            out.append(np.array([int.from_bytes(blake2b(data[last:end], digest_size=8).digest(), "little")], np.uint64))
        at = end
    return np.concatenate([np.zeros(0, np.uint64), *out])


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of whole texts."""
    data = [(t or "").encode("utf-8").translate(_TO_WORDS) for t in texts]
    if sum(map(len, data)) + len(data) <= PIECE:
        borders = np.cumsum([0, *(len(d) + 1 for d in data)])
        first, h = _short_word_hashes(b" ".join(data))
        borders = np.searchsorted(first, borders).tolist()
    else:
        each = [_word_hashes(d) for d in data]
        borders = np.cumsum([0, *map(len, each)]).tolist()
        h = np.concatenate(each)

    def shingles(h: np.ndarray, width: int) -> np.ndarray:
        n = max(0, len(h) - width + 1)
        total = np.full(n, width, np.uint64)
        for i in range(width):
            total = _mix(total + h[i : i + n] * _MULTIPLIERS[i])
        return total

    whole = shingles(h, words)
    return [np.unique(whole[a : b - words + 1]) if b - a >= words else shingles(h[a:b], b - a)[: b - a] for a, b in zip(borders[:-1], borders[1:])]


def _groups(cells: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch in runs that fit a piece; a longer text is a run of its own."""
    held, size = [], 0
    for cell in cells:
        text = cell.as_py()
        n = 4 * len(text or "") if not (text or "").isascii() else len(text or "")
        if held and (size + n + len(held) >= PIECE or len(held) == TEXTS_AT_ONCE):
            yield held
            held, size = [], 0
        held.append(text)
        size += n
    if held:
        yield held


def _print_of(shingles: np.ndarray) -> bytes | None:
    """A 128-bit fingerprint of a set, nothing for the empty set."""
    return blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _windows() -> np.ndarray:
    """The shifted permutation: row p holds the table values p, p + 1, ... places round the ring."""
    if not _table:
        table = np.random.default_rng(20_240_502).permutation(RING).astype(np.uint32)
        k = BANDS * ROWS
        _table.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[: k - 1]]), k))
    return _table[0]


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit bucket key for each band of the signature, a row for each set."""
    windows = _windows()
    signature = np.full((len(sets), BANDS * ROWS), RING, np.uint32)
    for own, shingles in zip(signature, sets):
        place = (_mix(shingles + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(RING - 1)).astype(np.int64)
        for i in range(0, len(place), 512):
            np.minimum(own, windows[place[i : i + 512]].min(axis=0), out=own)
    rows = signature.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS))
    for r in range(ROWS):
        key = _mix(key + rows[:, :, r] * _MULTIPLIERS[8 + r])
    return key.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, content`` (a hash of the text) ``, n_shingles, fingerprint`` (of the set, null if empty) ``, bands``; one narrow pass."""
    names = ["doc_id", "content", "n_shingles", "fingerprint", "bands"]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            for texts in _groups(whole.column(2)):
                batch = whole.slice(at, len(texts))
                at += len(texts)
                sets = shingle_sets(texts)
                keys = iter(band_hashes([s for s in sets if len(s)]))
                bands = pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))
                columns = [batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(map(_print_of, sets), pa.binary()), bands]
                yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    return slim.mapInArrow(sketched, "doc_id bigint, content bigint, n_shingles bigint, fingerprint binary, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """``rep, shingles`` (binary, sorted 64-bit hashes) of the classes ``wanted(rep, first, fingerprint)``, from a row of theirs."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("first"), "text").join(wanted, "first").select("rep", "fingerprint", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            for texts in _groups(whole.column(2)):
                batch = whole.slice(at, len(texts))
                at += len(texts)
                sets = shingle_sets(texts)
                own = pa.array([_print_of(s) == p for s, p in zip(sets, batch.column(1).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"]).filter(own)

    found = chosen.mapInArrow(made, "rep bigint, shingles binary")
    return found.dropDuplicates(["rep"]) if repeated else found


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose full sets are similar enough."""
    total = pairs.count()
    size = lambda k: pairs.groupBy(k).agg(F.count("*").alias("size"))
    left = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b"))
    both = join_hot(join_hot(pairs, right, ["v"], "u", size("v"), total), left, ["u"], "v", size("u"), total).select("u", "v", "a", "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                merged = np.sort(np.concatenate([a, b]), kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compared, "u bigint, v bigint")


def _shared_shingles(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rep, c``: how many shingles of each document of ``chosen(rep, n)`` some other chosen document has too."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["rep", "tokens"])

    own = sets.join(chosen.select("rep"), "rep", "left_semi").select("rep", "shingles")
    tokens = own.mapInArrow(listed, "rep bigint, tokens array<bigint>").select("rep", F.explode("tokens").alias("token"))
    common = Stored(tokens.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1"), "common-shingles")
    met = join_hot(tokens, common.df.select("token"), ["token"], "rep", common.df, chosen.agg(F.sum("n")).first()[0])
    out = cut(met.groupBy("rep").agg(F.count("*").alias("c")))
    common.drop()
    return out


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each part of the hash space: is the number of the set's shingles in it odd?  Packed in words of 64 bits."""
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _with_parities(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``odd``, the parities of each document's set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = [parities(np.frombuffer(x.as_py(), np.uint64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odd, pa.list_(pa.int64()))], ["rep", "odd"])

    own = sets.join(left.select("rep").distinct(), "rep", "left_semi").select("rep", "shingles")
    return left.join(cut(own.mapInArrow(made, "rep bigint, odd array<bigint>")), "rep")


def _open_pairs(member: DataFrame, pivot: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame | None:
    """Pairs ``u, v`` of different components that share a bucket, could link, and weren't compared with its pivot."""
    at = member.join(comp, member["rep"] == comp["node"], "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    at = at.join(pivot.select("bucket", F.col("pivot").alias("rep")), ["bucket", "rep"], "left_anti")

    def still_open(df: DataFrame) -> DataFrame:
        mixed = df.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
        mixed = cut(mixed.select("bucket", "size"))
        return cut(join_hot(df, mixed, ["bucket"], "rep", mixed, total))

    left = still_open(at.select("bucket", "rep", "n", "component"))
    for _ in range(TRIMS):
        if not left.take(1):
            return None
        c = _shared_shingles(sets, left.select("rep", "n").distinct())
        left = still_open(left.drop("c", "size").join(c, "rep").filter(100 * F.col("c") >= percent * F.col("n")))
    left = _with_parities(left, sets)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own, each = F.pmod(F.xxhash64("rep"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    x = left.select("bucket", "rep", "n", "c", "component", "odd", own.alias("i"), each.alias("j"))
    y = left.select("bucket", *[F.col(k).alias(f"{k}_y") for k in ("rep", "n", "c", "component", "odd")], own.alias("j"), each.alias("i"))
    enough = (100 + percent) * F.least("c", "c_y", "n", "n_y") >= percent * (F.col("n") + F.col("n_y"))
    differ = sum((F.bit_count(F.get("odd", F.lit(k)).bitwiseXOR(F.get("odd_y", F.lit(k)))) for k in range(PARITY // 64)), F.lit(0))
    alike = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("n_y"))
    met = x.join(y, ["bucket", "i", "j"]).filter((F.col("rep") < F.col("rep_y")) & (F.col("component") != F.col("component_y")) & enough & alike)
    return cut(met.select(F.col("rep_y").alias("u"), F.col("rep").alias("v")).distinct())


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, bool]:
    """``doc_id, content, n_shingles, component_id, kept`` of each row, and whether ids repeat."""
    found = Stored(sketch(docs), "sketches")
    nonempty = found.df.filter("fingerprint is not null and doc_id is not null")
    repeated = bool(found.df.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").take(1))
    classes = nonempty.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("size"))
    if repeated:  # the smallest id doesn't tell classes apart: they are numbered in its order
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = classes.repartitionByRange(parts, "first", "fingerprint").sortWithinPartitions("first", "fingerprint")
        rows = Stored(ordered.withColumn("rep", F.monotonically_increasing_id()), "classes")
    else:
        rows = Stored(classes.withColumn("rep", F.col("first")), "classes")

    # the members of buckets that have more than one
    spread = rows.df.select("rep", "n", F.explode("bands").alias("bucket"))
    total = rows.df.count() * BANDS
    shared = Stored(spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "shared-buckets")
    member = Stored(join_hot(spread, shared.df, ["bucket"], "rep", shared.df, total), "buckets")
    hub = cut(member.df.groupBy("rep").agg(F.sum("size").alias("met")))
    sets = Stored(_sets(docs, rows.df.select("rep", "first", "fingerprint").join(hub, "rep", "left_semi"), repeated), "shingle-sets")

    # one pivot for each bucket, found by an aggregate that is summed up before the shuffle
    known = member.df.join(hub, "rep")
    best = known.groupBy("bucket").agg(F.max(F.struct("met", -F.col("rep"), "n")).alias("_p"))
    pivot = cut(best.select("bucket", (-F.col("_p.col2")).alias("pivot"), F.col("_p.n").alias("pn")))
    meet = join_hot(member.df, pivot, ["bucket"], "rep", shared.df, total).filter("rep <> pivot").filter(100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))
    pairs = cut(meet.select(F.least("rep", "pivot").alias("v"), F.greatest("rep", "pivot").alias("u")).distinct())
    links = cut(_confirmed(pairs, sets.df, percent))
    comp = cut(components(links))

    rest = _open_pairs(member.df.drop("size"), pivot, comp, sets.df, percent, total)
    if rest is not None:
        more = cut(_confirmed(rest, sets.df, percent))
        if more.take(1):
            hung = comp.select(F.col("node").alias("u"), F.col("component").alias("v")).filter("u <> v")
            comp = cut(components(hung.unionByName(more)))
    for done in (shared, member, sets):
        done.drop()

    if repeated:
        comp = comp.join(rows.df.select(F.col("rep").alias("component"), "first"), "component").select("node", F.col("first").alias("component"))
    own = rows.df.select("fingerprint", "rep", "first").join(comp, F.col("rep") == F.col("node"), "left")
    own = own.select("fingerprint", F.coalesce("component", "first").alias("_component"))
    # a large group of exact copies shares one fingerprint
    copies = rows.df.select("fingerprint", "size")
    told = join_hot(nonempty.select("doc_id", "content", "n_shingles", "fingerprint"), own, ["fingerprint"], "doc_id", copies, found.df.count()).drop("fingerprint")
    alone = found.df.filter("fingerprint is null or doc_id is null").select("doc_id", "content", "n_shingles", F.lit(None).cast("bigint").alias("_component"))
    whole = told.unionByName(alone)
    component = F.coalesce("_component", "doc_id")
    return whole.select("doc_id", "content", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), repeated


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``."""
    return _grouped(docs, percent)[0].select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with its columns unchanged; rows without words and rows without a doc_id all stay.

    Rows are told apart by id and text: where several rows of a component have its smallest id, the text with the smallest
    hash stays; of rows equal in id and text one stays.
    """
    found, repeated = _grouped(docs, percent)
    if repeated:
        alike = found.filter("kept and n_shingles > 0 and doc_id is not null").groupBy("component_id").agg(F.min("content").alias("_least"))
        found = found.join(alike, "component_id", "left").withColumn("kept", F.col("kept") & ((F.col("n_shingles") == 0) | (F.coalesce("_least", "content") == F.col("content"))))
    copies = cut(found.filter("not kept").select("doc_id", "content").distinct())
    own = docs.withColumn(key := unused(docs, "_content"), F.xxhash64("text"))
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    same = (own["doc_id"].cast("bigint") == copies["doc_id"]) & (own[key] == copies["content"])
    alone = own.join(copies, same, "left_anti")
    if repeated:
        alone = alone.filter("doc_id is null").unionByName(alone.filter("doc_id is not null").dropDuplicates(["doc_id", key]))
    return alone.select(*docs.columns)
