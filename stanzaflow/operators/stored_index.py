"""A full-text index that is kept: trigram postings in buckets, added to and deleted from, and searched without the texts.

Each batch of documents is a segment: ``doc_id, length``, and postings ``token, ids, ends, positions``, partitioned by a hash bucket of the token
and sorted by token within.  A row of them tells of a block of documents: the positions of all, and where those of each end.  Blocks are
made where the texts lie, so positions are never shuffled: an added text is, once.  A search reads the buckets of its
trigrams only, and of those the row groups that can hold them.  Positions tell whether the trigrams stand one behind another, so a literal query is verified without its texts.

A document that is deleted or added anew gets a mark (``doc_id, upto``): postings of segments up to that number no longer count.
Segments, marks and the number and length of the documents that count are pinned together by one row of a manifest (``sources.snapshot``), so
readers see one state, and a writer that fails changes nothing.  ``compact`` makes one segment of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.text import text_of
from ..sources.snapshot import Snapshot, current, publish_set
from .search import K1, B, query_trigrams, trigram_length

BUCKETS = 64
TASK_CHARS = 1 << 25  # of the texts of a task: it sorts their postings in memory
BLOCK_CHARS = 1 << 20  # of the documents of a block, more if one document has more


def bucket_of(token, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _block(ids: list[pa.Array], texts: list[str]) -> pa.RecordBatch:
    """``token, ids, ends, positions`` of some documents, by token, document and place."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(place + 3 <= lengths[doc])
    gram = code[at] << 42 | code[at + 1] << 21 | code[at + 2]  # a code point has 21 bits
    order = np.argsort(gram, kind="stable")
    gram, at = gram[order], at[order]
    doc, place = doc[at], place[at].astype(np.int32)
    token = np.flatnonzero(np.diff(gram, prepend=-1))  # the first place of each token, and of each document of a token
    entry = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    first = np.searchsorted(entry, token)
    base = np.repeat(token, np.diff(np.append(first, len(entry))))
    ends = (np.append(entry[1:], len(gram))[: len(entry)] - base).astype(np.int32)
    by_entry, by_place = (pa.array(np.append(x, n).astype(np.int32)) for x, n in ((first, len(entry)), (token, len(gram))))
    of = pa.concat_arrays(ids).take(pa.array(doc[entry]))
    tokens = [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in gram[token].tolist()]
    columns = [pa.array(tokens, pa.string()), pa.ListArray.from_arrays(by_entry, of), pa.ListArray.from_arrays(by_entry, pa.array(ends)), pa.ListArray.from_arrays(by_place, pa.array(place))]
    return pa.RecordBatch.from_arrays(columns, ["token", "ids", "ends", "positions"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for n, text in enumerate(batch.column(1).to_pylist()):
            if len(text) < 3:
                continue
            ids.append(batch.column(0).slice(n, 1))
            texts.append(text)
            held += len(text)
            if held >= BLOCK_CHARS:
                yield _block(ids, texts)
                ids, texts, held = [], [], 0
    if texts:
        yield _block(ids, texts)


class StoredIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = int(self._state().facts.get("buckets", buckets))

    def _state(self) -> Snapshot:
        return current(self.spark, self.root)

    def _segments(self, state: Snapshot) -> list[int]:
        return sorted(int(n.split("_")[1]) for n in state.tables if n.startswith("docs_"))

    def _live(self, state: Snapshot, rows: DataFrame) -> DataFrame:
        """Rows ``doc_id, segment, ...`` without those that a mark takes out."""
        if "marks" not in state.tables:
            return rows
        upto = state.read("marks").groupBy("doc_id").agg(F.max("upto").alias("_upto"))
        return rows.join(upto, "doc_id", "left").filter(F.col("_upto").isNull() | (F.col("segment") > F.col("_upto"))).drop("_upto")

    def _docs(self, state: Snapshot) -> DataFrame | None:
        parts = [state.read(f"docs_{s}").withColumn("segment", F.lit(s)) for s in self._segments(state)]
        whole = None
        for p in parts:
            whole = p if whole is None else whole.unionByName(p)
        return whole if whole is None else self._live(state, whole)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents; one that is there already is replaced.  Of several rows with one id the first by text counts; rows without an id don't."""
        state = self._state()
        number = max(self._segments(state), default=0) + 1
        texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        most = texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).agg(F.max("n").alias("n"), F.sum("chars").alias("chars")).first()
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-int(most["chars"] or 0) // TASK_CHARS))
        dealt = texts.repartition(tasks, "doc_id")
        if (most["n"] or 0) > 1:
            texts = dealt = dealt.groupBy("doc_id").agg(F.min("text").alias("text"))
        slim = texts.select("doc_id", trigram_length("text").cast("bigint").alias("length"))
        kind = S.StructType().add("token", "string").add("ids", S.ArrayType(texts.schema["doc_id"].dataType)).add("ends", S.ArrayType(S.IntegerType())).add("positions", S.ArrayType(S.IntegerType()))
        postings = dealt.select("doc_id", F.lower(text_of("text")).alias("text")).mapInArrow(_blocks, kind)
        postings = postings.withColumn("bucket", bucket_of("token", self.buckets)).sortWithinPartitions("bucket", "token")
        new = {f"docs_{number}": slim, f"postings_{number}": postings}
        if state.number:  # what is replaced
            marks = slim.join(self._docs(state).select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(number - 1).alias("upto"))
            new["marks"] = marks if "marks" not in state.tables else state.read("marks").unionByName(marks)
        self._publish(new, {f"postings_{number}": ["bucket"]})

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take documents out; ids that aren't there change nothing."""
        state = self._state()
        if not state.number:
            return
        gone = ids.select(F.col(id_col).alias("doc_id")).distinct().join(self._docs(state).select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(max(self._segments(state))).alias("upto"))
        self._publish({"marks": gone if "marks" not in state.tables else state.read("marks").unionByName(gone)}, {})

    def compact(self) -> None:
        """One segment of all that counts, without marks."""
        state = self._state()
        if not state.number:
            return
        number = max(self._segments(state)) + 1
        one = F.array("doc_id").alias("ids"), F.array(F.size("positions")).alias("ends")
        postings = self._postings(state).select("token", *one, "positions", bucket_of("token", self.buckets).alias("bucket"), "doc_id")
        postings = postings.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "token", "doc_id").drop("doc_id")
        self._publish({f"docs_{number}": self._docs(state).drop("segment"), f"postings_{number}": postings}, {f"postings_{number}": ["bucket"]}, keep=[])

    def _publish(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]], keep: list[str] | None = None) -> None:
        def facts(state: Snapshot) -> dict:
            sums = self._docs(state).agg(F.count("*").alias("n"), F.sum("length").alias("length")).first()
            return {"buckets": self.buckets, "n": sums["n"], "length": int(sums["length"] or 0)}

        publish_set(self.spark, self.root, tables, keep, facts, partition_by)

    def _postings(self, state: Snapshot, tokens: list[str] | None = None) -> DataFrame:
        """Postings that count, of some tokens: filters on bucket and token reach the files."""
        whole = None
        for s in self._segments(state):
            rows = state.read(f"postings_{s}")
            if tokens is not None:
                buckets = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in tokens], "t string").select(bucket_of("t", self.buckets)).collect()})  # a query's trigrams
                rows = rows.filter(F.col("bucket").isin(buckets) & F.col("token").isin(tokens))
            start = lambda n: F.when(n > 0, F.get("ends", n - 1)).otherwise(0)
            own = F.transform("ids", lambda i, n: F.struct(i.alias("doc_id"), F.slice("positions", start(n) + 1, F.get("ends", n) - start(n)).alias("positions")))
            rows = rows.select("token", F.explode(own).alias("_p")).select("token", "_p.doc_id", "_p.positions", F.lit(s).alias("segment"))
            whole = rows if whole is None else whole.unionByName(rows)
        return self._live(state, whole)

    def search(self, query: str) -> DataFrame:
        """``doc_id, score`` of the documents that hold the query literally, in any case, as ``search.bm25`` scores them; larger is better."""
        q = query.lower()
        grams = query_trigrams(query)
        if not grams:
            raise ValueError("a query needs three characters at least")
        state = self._state()
        if not state.facts.get("n"):
            raise ValueError("the index has no documents")
        hit = self._postings(state, grams)
        n_docs, average = state.facts["n"], state.facts["length"] / state.facts["n"]
        with_df = hit.join(F.broadcast(hit.groupBy("token").agg(F.count("*").alias("_df"))), "token")  # a row for each trigram of the query
        listed = with_df.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("positions", "_df")))).alias("_p"))  # no more than a query's trigrams
        listed = listed.filter(F.size("_p") == len(grams))
        # places where every trigram of the query stands, counted from its first one
        def starts_of(i: int) -> Column:
            return F.transform(F.element_at("_p", q[i : i + 3])["positions"], lambda p: p - i)

        starts = starts_of(0)
        for i in range(1, len(q) - 2):
            starts = F.array_intersect(starts, starts_of(i))
        held = listed.filter(F.size(starts) > 0)
        lengths = self._docs(state).select("doc_id", "length")
        score = F.lit(0.0)
        for g in grams:
            entry = F.element_at("_p", g)
            tf, df = F.size(entry["positions"]), entry["_df"]
            score += F.log(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / average))
        return held.join(lengths, "doc_id").select("doc_id", F.round(score, 6).alias("score"))
