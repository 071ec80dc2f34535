"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

One weight vector is shared by all ordered thresholds: P(grade > k) = sigmoid(w.x - t_k) with
t_0 < t_1 < ...  The severity of a document is the expected grade, the sum of these probabilities.

Features are the presence of words and of word beginnings (4 and 5 bytes), taken from the whole text.
Which ones enter the model is decided by their association with the label over the training sample
(G statistic), up to ``FEATURES``.

The labels say only toxic or not.  Grades for training come from them: 0 for clean documents; toxic ones
are parted at the median number of marker words (features seen almost only in toxic documents)
into grade 1 and grade 2.

Training reads at most ``SAMPLE_DOCS`` labelled documents of each class (a documented bound, those with
the smallest hash of their id).  Counting features and extracting them run on Spark; the driver
fits the weights on the resulting bounded matrix.

Defined cases: null and empty texts have no features and get the base severity; labels that are null
or without a document are not used; a document with several labels is used with each; repeated rows are graded each;
without labels of both classes every severity is 0 and nothing is toxic; scores don't depend on other rows; a text's
length isn't limited; an empty table gives an empty result; extra columns are kept by ``reject_toxic`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash
from .decontam import words_of

GRADES = 3
FEATURES = 2000
SAMPLE_DOCS = 4000  # of each class
MIN_DOCS = 5  # documents of the sample that must hold a feature
MARKER_ODDS = 3.0  # log odds from which a feature marks toxic text
ROUNDS, RATE, RIDGE = 400, 0.05, 1e-3
BEGINNINGS = (4, 5)


def features_of(text: str | None) -> set[bytes]:
    """Distinct words (followed by a blank) and word beginnings."""
    words = set(words_of(text.lower())) if text else set()
    found = {w + b" " for w in words}
    for n in BEGINNINGS:
        found.update([w[:n] for w in words if len(w) > n])
    return found


@dataclass
class OrdinalModel:
    """Weights by feature and rising thresholds."""

    weights: dict[bytes, float]
    thresholds: list[float]

    def exceedance(self, text: str | None) -> list[float]:
        """P(grade > k) for each threshold."""
        if not self.thresholds:
            return []
        found = self.weights.keys() & features_of(text)
        s = sum(sorted(self.weights[f] for f in found))
        return [float(_sigmoid(s - t)) for t in self.thresholds]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by regularised maximum likelihood (Adam, full batch).

    ``row``/``col`` list the present features of the sampled documents.  The gaps between thresholds
    are kept positive by fitting their logarithms.
    """
    n, k = len(grade), grades - 1
    params = np.zeros(n_features + k)
    params[n_features] = 1.0
    m = np.zeros_like(params)
    v = np.zeros_like(params)
    for step in range(1, ROUNDS + 1):
        w, raw = params[:n_features], params[n_features:]
        gaps = np.exp(raw[1:])
        t = np.concatenate([raw[:1], raw[:1] + np.cumsum(gaps)])
        s = np.bincount(row, w[col], n)
        above = np.column_stack([np.ones(n), _sigmoid(s[:, None] - t), np.zeros(n)])
        slope = above * (1 - above)
        lo, hi = above[np.arange(n), grade], above[np.arange(n), grade + 1]
        p = np.maximum(lo - hi, 1e-12)
        d_lo, d_hi = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        d_s = -(d_lo - d_hi) / n
        d_t = np.zeros(k)
        np.add.at(d_t, np.maximum(grade - 1, 0), np.where(grade > 0, d_lo, 0) / n)
        np.add.at(d_t, np.minimum(grade, k - 1), np.where(grade < k, -d_hi, 0) / n)
        g = np.concatenate([np.bincount(col, d_s[row], n_features) + RIDGE * w, [d_t.sum()], gaps * np.cumsum(d_t[::-1])[::-1][1:]])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    raw = params[n_features:]
    return params[:n_features], np.concatenate([raw[:1], raw[:1] + np.cumsum(np.exp(raw[1:]))])


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    chosen = first_by_hash(known, "toxic", SAMPLE_DOCS)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # 2 * SAMPLE_DOCS rows at most


def train(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    """Fit the model on a bounded sample of ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``."""
    sample = _sample(docs, labels)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for f in features_of(text.as_py()) | {b""}:  # the empty one counts documents
                    seen.setdefault(f, [0, 0])[toxic] += 1
        columns = [pa.array(list(seen), pa.binary()), *(pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])

    counts = sample.mapInArrow(counted, "feature binary, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.filter(F.col("clean") + F.col("toxic") >= MIN_DOCS)
    totals = counts.filter(F.octet_length("feature") == 0).collect()
    if not totals or not totals[0]["clean"] or not totals[0]["toxic"]:
        return OrdinalModel({}, [])
    n0, n1 = totals[0]["clean"], totals[0]["toxic"]
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (n1 + 1.0)) - F.log(b / (n0 + 1.0))
    share = (F.col("toxic") + F.col("clean")) / float(n0 + n1)
    gain = a * F.log(a / (share * n1)) + b * F.log(b / (share * n0))
    chosen = (
        counts.filter(F.octet_length("feature") > 0)
        .select("feature", odds.alias("odds"), gain.alias("gain"))
        .orderBy(F.desc("gain"), "feature")
        .limit(FEATURES)
        .collect()
    )
    names = [bytes(r["feature"]) for r in chosen]
    marker = np.array([r["odds"] >= MARKER_ODDS for r in chosen], bool)
    index = {f: i for i, f in enumerate(names)}

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index[f] for f in index.keys() & features_of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "present"])

    rows = sorted((r["toxic"], r["present"]) for r in sample.mapInArrow(extracted, "toxic int, present array<int>").collect())
    toxic = np.array([r[0] for r in rows])
    size = np.array([len(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    col = np.concatenate([np.array(r[1], np.int64) for r in rows] + [np.zeros(0, np.int64)])
    marks = np.bincount(row, marker[col], len(rows))
    grade = np.where(toxic == 0, 0, np.where(marks > np.median(marks[toxic == 1]), 2, 1))
    weights, thresholds = fit_ordinal(row, col, grade, len(names))
    return OrdinalModel({f: float(w) for f, w in zip(names, weights)}, [float(t) for t in thresholds])


def grade_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, severity, grade, toxic`` of each row of ``docs(doc_id, text)``; one narrow pass.

    ``grade`` is the highest one reached with probability 0.5 or more; toxic means a grade over 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, severity double, grade int, toxic boolean"

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            above = [model.exceedance(t.as_py()) for t in batch.column(1)]
            grade = [sum(p >= 0.5 for p in a) for a in above]
            columns = [batch.column(0), pa.array([sum(a) + 0.0 for a in above], pa.float64()), pa.array(grade, pa.int32()), pa.array([g > 0 for g in grade], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(graded, schema)


def reject_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with their columns unchanged; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            toxic = [any(p >= 0.5 for p in model.exceedance(t.as_py())) for t in batch.column(text)]
            yield batch.filter(pa.array([not t for t in toxic], pa.bool_()))

    return docs.mapInArrow(passed, docs.schema)
