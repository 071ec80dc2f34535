"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

File format.  A token file set is a folder of three tables that Spark's committer writes, so a task
that is lost and run again leaves no half-written file:

* ``ranks``: ``rank, id, n`` - the ids by falling frequency (ties: the smaller id first).
* ``blocks``: one row per run of consecutive documents in doc_id order:
  ``part, block`` (their place in the order), ``before`` (ids of the part before the block), ``n_ids``,
  ``doc_ids array<bigint>``, ``lengths array<int>`` (ids of each document),
  ``control binary`` and ``data binary``.
* ``parts``: ``part, first`` - the ids before each part.

Coding of a block: each id is replaced by its rank, and a rank takes 1 to 4 little-endian bytes in
``data``.  ``control`` holds two bits per id (bytes taken, less one), four ids to a byte, the first in
the lowest bits.  Frequent ids have small ranks and so take one byte.  A decoder looks a control
byte up in a table of 256 rows to get four lengths at once.

Defined cases: a null or empty text holds the end id alone; documents with the same doc_id are kept
and stand next to each other, ordered by their ids; a null doc_id comes first; an empty table gives
an empty file set; repeated rows are written each; ids of equal count are ranked by their number; extra columns aren't
read, whatever their names.  No document is split over blocks.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, scratch_dir
from .token_count import tokenizer_path

END_ID = 2
BLOCK_IDS = 262_144  # a block is closed once it holds so many ids
MEMO_BYTES = 160 << 20  # of words whose ids a worker keeps before it starts afresh
ENTRY_BYTES = 180  # what a word takes beside its characters
LONGEST_KEPT = 64  # characters; longer words are encoded each time they are met
#: Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Texts with these may change their words when ASCII letters are lower-cased before the normaliser, or are cut before marks: a
#: letter beyond Latin-1, a sign between U+0080 and U+00BF, or the start of a special token.
UNUSUAL = r"[^\x00-\x7F\x{C0}-\x{FF}]|<\|"
#: A run of signs in other texts; the tokenizer always cuts before one.
MARKS = r"[^\s0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+"
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)  # of a control byte's four ids


# ---------------------------------------------------------------- encoding texts

def id_kind(vocabulary: int) -> str:
    """Width of the ids on their way to the files: 16 bits where the vocabulary allows it."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class TextEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each word.

    The vocabulary must treat white space as a border that no token and no normaliser rule crosses,
    and drop it; ``_borders`` checks that on the tokenizer's own description.  Then the ids of a text
    are the ids of its stretches between blanks and line ends, one after another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = self._borders(self.tokenizer.to_str())
        self.kind = id_kind(self.tokenizer.get_vocab_size())
        self.memo: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _borders(description: str) -> bool:
        import json

        spec = json.loads(description)
        norm = spec.get("normalizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [norm] if norm else [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = pre[0] if pre else {}
        return (
            set(kinds) <= {"NFC", "Lowercase", "Replace"}
            and "Lowercase" in kinds
            and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
            and split.get("behavior") == "Removed"
            and split.get("invert") is True
            and "[^\\s" in split.get("pattern", {}).get("Regex", "")
            and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"])
        )

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind == "<u2" else "I"  # little-endian machines, as Spark's Arrow exchange assumes
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words; a plain word goes straight to the library's merges, spelled as its byte-level alphabet spells it."""
        code = "H" if self.kind == "<u2" else "I"
        tokenize = self.tokenizer.model.tokenize
        found, rest = {}, []
        for w in words:
            if not w.isalpha():
                rest.append(w)
            elif w.isascii():
                found[w] = array(code, [t.id for t in tokenize(w.lower())]).tobytes()
            elif max(w) <= "\xff":
                found[w] = array(code, [t.id for t in tokenize(w.lower().encode().decode("latin-1").translate(BYTE_ALPHABET))]).tobytes()
            else:
                rest.append(w)
        found.update(zip(rest, self._ids(rest)))
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned ids of each text, ``self.kind`` wide.

        Arrow cuts the texts into words and numbers the distinct ones; those are looked up or learned, and
        numpy puts their ids together for all texts at once.
        """
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return self._ids(texts.to_pylist())
        odd = pc.match_substring_regex(texts, UNUSUAL)
        usual = pc.replace_substring_regex(pc.ascii_lower(texts), MARKS, r" \0")
        texts = pc.if_else(odd, texts, usual)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        cells = self._learned(coded.dictionary.to_pylist())
        width = int(self.kind[-1])
        size = np.fromiter(map(len, cells), np.int64, len(cells)) // width
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(cells), self.kind)[place]
        borders = ends[words.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:])]

    def _learned(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from memory where they have been met before; the memory is bounded in bytes."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        memo = self.memo
        found = self._word_ids([w for w in words if w not in memo])
        kept = {w: ids for w, ids in found.items() if len(w) <= LONGEST_KEPT}
        self.held += sum(map(len, kept)) + ENTRY_BYTES * len(kept)
        memo.update(kept)
        return [memo[w] if w in memo else found[w] for w in words]


_encoders: dict[str, TextEncoder] = {}


def _encoder(name: str) -> TextEncoder:
    if name not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[name] = TextEncoder(tokenizer_path(name))
    return _encoders[name]


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids`` (binary, unsigned little-endian in the encoder's width, the end id last) of each row."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.asarray([end_id], encoder.kind).tobytes()
        for whole in batches:
            for batch in _slices(whole, 512):
                ids = [x + end for x in encoder.encode(batch.column(1).cast(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(encoded, "doc_id bigint, ids binary")


# ---------------------------------------------------------------- coding ids

def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    r = np.ascontiguousarray(ranks, "<u4")
    code = (r >= 1 << 8).astype(np.uint8) + (r >= 1 << 16) + (r >= 1 << 24)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = code
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: lengths by table lookup, then all bytes put in place at once."""
    code = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) <= code[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


# ---------------------------------------------------------------- files

def _histogram(encoded: DataFrame, kind: str) -> DataFrame:
    """``id, n`` over all documents; each task adds up its own counts before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                n = np.bincount(np.frombuffer(x.as_py(), kind))
                if len(n) > len(total):
                    n[: len(total)] += total
                    total = n
                else:
                    total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return encoded.select("ids").mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(ordered: DataFrame, kind: str, shared) -> DataFrame:
    """Consecutive documents of each range partition in coded blocks, with the ids before them there."""
    width = int(kind[-1])
    fields = [
        ("part", pa.int32(), "int"), ("block", pa.int32(), "int"), ("before", pa.int64(), "bigint"), ("n_ids", pa.int64(), "bigint"),
        ("doc_ids", pa.list_(pa.int64()), "array<bigint>"), ("lengths", pa.list_(pa.int32()), "array<int>"), ("control", pa.binary(), "binary"), ("data", pa.binary(), "binary"),
    ]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = shared.value
        part, block, before, docs, ids, held = 0, 0, 0, [], [], 0

        def full() -> pa.RecordBatch:
            control, data = pack(rank_of[np.frombuffer(b"".join(ids), kind)])
            row = [part, block, before, held, docs, [len(x) // width for x in ids], control, data]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k, _) in zip(row, fields)], [f[0] for f in fields])

        for batch in batches:
            for part, d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs.append(d)
                ids.append(x.as_py())
                held += len(ids[-1]) // width
                if held >= BLOCK_IDS:
                    yield full()
                    block, before, docs, ids, held = block + 1, before + held, [], [], 0
        if docs:
            yield full()

    schema = ", ".join(f"{name} {sql}" for name, _, sql in fields)
    return ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(grouped, schema)


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` and write the token files under ``path`` in ascending doc_id order.

    Each text is encoded once; after that only ids move: one range shuffle puts them in order, and
    the places of blocks follow from one sum for each partition.  To the driver come the histogram
    (at most the vocabulary's size) and those sums (one for each partition).
    """
    spark = docs.sparkSession
    kind = _encoder(tokenizer).kind
    encoded = Stored(encode_documents(docs, tokenizer, end_id), "token-ids")
    by_rank = _histogram(encoded.df, kind).toPandas().sort_values(["n", "id"], ascending=[False, True])
    ids = by_rank["id"].to_numpy(np.int64)
    ranks = [(r, int(i), int(c)) for r, (i, c) in enumerate(zip(ids, by_rank["n"]))]
    spark.createDataFrame(ranks, "rank bigint, id bigint, n bigint").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint32)
    rank_of[ids] = np.arange(len(ids))

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.df.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    _blocks(ordered, kind, spark.sparkContext.broadcast(rank_of)).write.option("compression", "none").parquet(f"{path}/blocks")
    encoded.drop()

    parts, at = [], 0
    for row in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        parts.append((row["part"], at))
        at += row["n"]
    spark.createDataFrame(parts, "part int, first bigint").coalesce(1).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` (binary, unsigned 32-bit little-endian) of each document in the files."""
    ids = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    first = {r["part"]: r["first"] for r in spark.read.parquet(f"{path}/parts").collect()}
    shared = spark.sparkContext.broadcast((ids, first))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of, first = shared.value
        for whole in batches:
            for row in _slices(whole, 1):
                r = row.to_pylist()[0]
                lengths = np.array(r["lengths"], np.int64)
                values = id_of[unpack(r["control"], r["data"], r["n_ids"])].astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                cells = [values[a:b].tobytes() for a, b in zip(starts, ends)]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["before"] + first[r["part"]], pa.int64()), pa.array(cells, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(decoded, "doc_id bigint, start bigint, ids binary")


def token_digest(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read_token_files`` gives."""
    n = (F.octet_length("ids") / 4).cast("bigint")
    return files.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def token_files(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Write the files into the shared folder, read them back, and return their digest."""
    import uuid

    path = f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer)
    return token_digest(read_token_files(docs.sparkSession, path))


__all__ = ["encode_documents", "pack", "read_token_files", "token_digest", "token_files", "unpack", "write_token_files"]
