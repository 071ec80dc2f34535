"""Token counts by byte-pair merging with a heap over a linked list of symbols.

The vocabulary (pieces and their ranks) is read from the tokenizer file; the merging is done here.
A text's count is its initial symbols minus the merges made; identifiers are never produced.

Two symbols can merge only if a piece holds their touching characters side by side.  A text is
therefore cut wherever no piece has the two neighbouring characters next to each other, and
each part is merged alone with the same outcome; parts and words already seen are looked up.

Defined cases: null and empty texts have 0 tokens; any length of text is counted whole; pairs of equal rank merge
from left to right; repeated rows are counted each, and a null doc_id is kept; an empty table gives an empty result;
extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # stands for a blank inside pieces
MEMO_BYTES = 48 << 20  # of words, and of parts, that a worker keeps before it starts afresh
ENTRY_BYTES = 120  # what an entry takes beside its characters
LONGEST_KEPT = 64  # characters; longer words are counted each time they are met
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def merge_count(symbols: str, rank: dict[str, float], single_cost) -> int:
    """Tokens of one stretch of text: initial symbols minus merges.

    Adjacent pairs wait in a heap by (rank, position).  The lowest is popped, its two symbols are
    joined in the linked list, and the pairs the new symbol makes with its neighbours are pushed.
    A popped pair one of whose symbols has changed since is stale and skipped.
    """
    n = len(symbols)
    if n == 1:
        return single_cost(symbols)
    piece = list(symbols)
    nxt = list(range(1, n)) + [-1]
    prv = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = rank.get(symbols[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 1, 2))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, a, b, size = heapq.heappop(heap)
        if not piece[a] or not piece[b] or len(piece[a]) + len(piece[b]) != size:
            continue
        merged = piece[a] + piece[b]
        piece[a], piece[b] = merged, ""
        merges += 1
        after = nxt[b]
        nxt[a] = after
        if after >= 0:
            prv[after] = a
            r = rank.get(merged + piece[after])
            if r is not None:
                heapq.heappush(heap, (r, a, after, size + len(piece[after])))
        before = prv[a]
        if before >= 0:
            r = rank.get(piece[before] + merged)
            if r is not None:
                heapq.heappush(heap, (r, before, a, size + len(piece[before])))
    # a character without a piece of its own is spelled in bytes: so many initial symbols more
    spelled = sum(single_cost(p) - 1 for p in piece if len(p) == 1)
    return n + spelled - merges


class _Memo(dict):
    """Results by key, computed on the first use; bounded in bytes, it forgets everything when it is full."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute
        self.held = 0

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= LONGEST_KEPT:
            self.held += ENTRY_BYTES + len(key)
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = ENTRY_BYTES + len(key)
            self[key] = value
        return value


class PieceCounter:
    """Counts tokens as a piece vocabulary with byte fallback gives them."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        pieces = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        self.rank = {p: r for p, r in pieces.items() if len(p) > 1}
        self.single = {p for p in pieces if len(p) == 1}
        self.together = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        # the cut at blanks below holds if no piece goes on after a blank that ends a word
        if any(a != SPACE and b == SPACE for a, b in self.together) or any("\n" in p for p in self.together):
            raise ValueError("pieces that span a word and a following blank or a line end are not supported")
        self.parts = _Memo(lambda part: merge_count(part, self.rank, self._cost))
        self.words = _Memo(lambda w: self._stretch(w if w[:1] == "\n" else SPACE + w))

    def _cost(self, char: str) -> int:
        return 1 if char in self.single else len(char.encode("utf-8"))

    def _stretch(self, s: str) -> int:
        """Count of a stretch, cut where no piece could reach across."""
        total, start, together = 0, 0, self.together
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in together:
                total += self.parts[s[start:i]]
                start = i
        return total + self.parts[s[start:]]

    def count(self, text: str) -> int:
        if not text:
            return 0
        spaced = text.replace("\n", " \n")  # a word that begins with a line end has no blank before it
        if "  " in spaced or SPACE in spaced or spaced[0] == " " or spaced[-1] == " ":
            return sum(map(self._stretch, _CHUNK.findall(SPACE + text.replace(" ", SPACE))))
        return sum(map(self.words.__getitem__, spaced.split(" ")))


_counters: dict[str, PieceCounter] = {}


def tokenizer_path(name: str) -> str:
    """A file path as given, or the place of a named vocabulary on this machine."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _counter(name: str) -> PieceCounter:
    if name not in _counters:
        _counters[name] = PieceCounter(tokenizer_path(name))
    return _counters[name]


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs(doc_id, text)``.

    One narrow pass without a shuffle: Arrow batches go to the workers, four columns come back.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    kind = pa.string()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in batches:
            texts = batch.column(1).cast(kind).to_pylist()
            n = pa.array([counter.count(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "text", F.octet_length(text).cast("bigint").alias("n_bytes"))
    return slim.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
