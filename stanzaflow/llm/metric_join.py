"""Near-duplicate embeddings: an exact metric range join.

Vectors on the unit sphere, a bound on the distance: cosine >= t means distance <= e = sqrt(2 - 2t).
Pivots part the vectors of a label into cells, each vector going home to its nearest pivot.  Let y be
at home with q, and x, within e of y, at home with p, so that |x-p| <= |x-q|.  By the triangle inequality y
is no further than e from the half space of points nearer to p, and the distance of y to its border is
(|y-p|^2 - |y-q|^2) / (2|p-q|).  So y is replicated to each cell p for which that is at most e.  Then every
vector meets all its partners within its home cell, and the cells join on their own.

Large cells are cut into blocks of home vectors by blocks of all vectors, a task for each pair of blocks,
so no task holds a whole cell.  A task returns a link count for each home vector and a spanning forest
of the links, never the list of pairs.  Equal vectors of a label are folded into one with a weight first.

At most ``MAX_PIVOTS`` pivots a label and ``ALL_PIVOTS`` of all labels are chosen by a hash of the id, so the broadcast is
bounded; with more vectors the cells grow and are cut into more blocks.

Vectors are first multiplied by a power of two that brings their largest component near 1.  That changes no cosine, and no
finite vector is so large or small that its length overflows or vanishes.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those
without a label or a vec_id, link with nothing; vectors of different lengths link with nothing; repeated rows
link with each other; rows that share a vec_id but not their vector are linked each by its own vector, and a component's id
is its smallest vec_id; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, cut, join_hot
from .graph import components

COSINE = 0.98
CELL = 2048  # vectors of a label for each pivot
MAX_PIVOTS = 256  # of a label and length
ALL_PIVOTS = 16_384
BLOCK = 2048
STRIP = 256
MARGIN = 1e-9  # added to the bound for rounding


def _valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, label`` (as text), ``vec`` (binary doubles, null if the vector links with nothing)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for label, vec in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ok = label is not None and vec and None not in vec
                v = np.array(vec, np.float64) if ok else np.zeros(0)
                ok = ok and bool(np.isfinite(v).all() and v.any())
                cells.append((np.ldexp(v, -np.frexp(np.abs(v).max())[1]) + 0.0).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], ["vec_id", "label", "vec"])

    slim = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>"))
    return slim.mapInArrow(read, "vec_id bigint, label string, vec binary")


def _matrix(cells) -> np.ndarray:
    return np.stack([np.frombuffer(c, np.float64) for c in cells])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _pivots(folded: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Unit pivots by label and length; a label with few vectors has none and is one cell."""
    size = F.octet_length("vec")
    counts = folded.groupBy("label", size.alias("size")).agg(F.count("*").alias("n")).withColumn("wanted", F.least(F.floor(F.col("n") / CELL), F.lit(MAX_PIVOTS)))
    counts = cut(counts.filter("wanted > 1").withColumnsRenamed({"label": "_label", "size": "_size"}))  # a row for each CELL vectors at most
    every = counts.agg(F.sum("wanted")).first()[0] or 0
    if every > ALL_PIVOTS:
        counts = counts.withColumn("wanted", F.floor(F.col("wanted") * ALL_PIVOTS / every)).filter("wanted > 1")
    near = (F.col("label") == F.col("_label")) & (size == F.col("_size"))
    chance = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.col("wanted") / F.col("n") * F.lit(float(1 << 30))
    found: dict[tuple[str, int], list[bytes]] = {}
    for r in folded.join(counts, near).filter(chance).select("label", "vec", "rep").orderBy("rep").collect():
        found.setdefault((r["label"], len(r["vec"])), []).append(r["vec"])
    return {k: _unit(_matrix(v)) for k, v in found.items()}


def _placed(folded: DataFrame, pivots: dict[tuple[str, int], np.ndarray], reach: float) -> DataFrame:
    """``label, size, cell, home, rep, weight, vec``: each vector at home and in the cells it is replicated to."""
    shared = folded.sparkSession.sparkContext.broadcast(pivots)
    schema = "label string, size int, cell int, home boolean, rep bigint, weight bigint, vec binary"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            keys = [(a, len(v)) for a, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows, cells, homes = [], [], []
            for key in set(keys):
                own = np.array([i for i, k in enumerate(keys) if k == key])
                p = pivots.get(key)
                if p is None or len(p) < 2:
                    rows.append(own), cells.append(np.zeros(len(own), int)), homes.append(np.ones(len(own), bool))
                    continue
                y = _unit(_matrix([batch.column(1)[int(i)].as_py() for i in own]))
                far = np.maximum(0.0, 2.0 - 2.0 * (y @ p.T))  # squared distances to pivots
                home = far.argmin(axis=1)
                apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T)))
                beyond = (far - far[np.arange(len(y)), home][:, None]) <= 2.0 * apart[home] * reach + MARGIN
                beyond[np.arange(len(y)), home] = True
                i, c = np.nonzero(beyond)
                rows.append(own[i]), cells.append(c), homes.append(home[i] == c)
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, int))
            whole = batch.take(at)
            size = pa.array([len(v) for v in whole.column(1).to_pylist()], pa.int32())
            columns = [whole.column(0), size, pa.array(np.concatenate(cells) if rows else [], pa.int32()), pa.array(np.concatenate(homes) if rows else [], pa.bool_()), whole.column(2), whole.column(3), whole.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["label", "size", "cell", "home", "rep", "weight", "vec"])

    return folded.select("label", "vec", "rep", "weight").mapInArrow(placed, schema)


def _forest(near: np.ndarray, x: np.ndarray, y: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Links that join parts not joined before; ``near`` marks links of rows x to columns y.

    ``x`` and ``y`` index ``part``, which holds each node's part and is brought up to date.
    """
    out = []
    for i, row in enumerate(near):
        to = y[row]
        parts, first = np.unique(part[to], return_index=True)
        for p, j in zip(parts, first):
            if p != part[x[i]]:
                out.append((x[i], to[j]))
                part[part == p] = part[x[i]]
    return out


def _join_blocks(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Link counts of the home vectors of one pair of blocks, and a spanning forest of the links."""
    home, others = rows[rows["side"] == 0], rows[rows["side"] == 1]
    counts = np.zeros(len(home), np.int64)
    x, y = home["rep"].to_numpy(np.int64), others["rep"].to_numpy(np.int64)
    edges: list[tuple[int, int]] = []
    if len(home) and len(others):
        a, b = _matrix(home["vec"]), _matrix(others["vec"])
        na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
        weight = others["weight"].to_numpy(np.int64)
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        part = np.arange(len(nodes))
        for i in range(0, len(a), STRIP):
            near = (a[i : i + STRIP] @ b.T) / (na[i : i + STRIP, None] * nb) >= cosine
            near &= x[i : i + STRIP, None] != y
            counts[i : i + STRIP] = near @ weight
            edges += [(int(nodes[u]), int(nodes[v])) for u, v in _forest(near, at[i : i + STRIP], at[len(x) :], part)]
    n = len(home) + len(edges)
    return pd.DataFrame(
        {
            "rep": np.concatenate([x, np.array([e[0] for e in edges], np.int64)]),
            "n": np.concatenate([counts, np.zeros(len(edges), np.int64)]),
            "to": pd.array([None] * len(home) + [e[1] for e in edges], "Int64") if n else pd.array([], "Int64"),
        }
    )


def link_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, label, embedding)``."""
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    rows = Stored(_valid(vectors), "vectors")
    good = rows.df.filter("vec is not null and vec_id is not null")
    classes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    repeated = bool(good.groupBy("vec_id").count().filter("count > 1").take(1))
    if repeated:  # the smallest id doesn't tell classes apart: they are numbered in its order
        order = ["first", "label", "vec"]
        parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        classes = classes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("rep", F.monotonically_increasing_id())
    else:
        classes = classes.withColumn("rep", F.col("first"))
    folded = Stored(classes, "folded")
    cells = Stored(_placed(folded.df, _pivots(folded.df), reach), "cells")

    key = ["label", "size", "cell"]
    sizes = cut(cells.df.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count("*").alias("n")))
    blocks = sizes.select(
        *key, F.greatest(F.ceil(F.col("homes") / BLOCK), F.lit(1)).cast("int").alias("home_blocks"), F.ceil(F.col("n") / BLOCK).cast("int").alias("all_blocks")
    )
    dealt = join_hot(cells.df, blocks, key, "rep", sizes, cells.df.count(), "n")
    number = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.filter("home").withColumn("i", number("home_blocks", 1)).withColumn("j", up_to("all_blocks")).withColumn("side", F.lit(0))
    right = dealt.withColumn("j", number("all_blocks", 2)).withColumn("i", up_to("home_blocks")).withColumn("side", F.lit(1))
    columns = [*key, "i", "j", "side", "rep", "weight", "vec"]
    both = left.select(*columns).unionByName(right.select(*columns))
    joined = Stored(both.groupBy(*key, "i", "j").applyInPandas(lambda pdf: _join_blocks(pdf, cosine), "rep bigint, n bigint, to bigint"), "links")

    degree = joined.df.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = cut(components(joined.df.filter("to is not null").select(F.col("rep").alias("u"), F.col("to").alias("v"))))
    if repeated:
        comp = comp.join(folded.df.select(F.col("rep").alias("component"), "first"), "component").select("node", F.col("first").alias("component"))
    cells.drop()
    found = (
        folded.df.join(degree, "rep", "left")
        .join(comp, F.col("rep") == F.col("node"), "left")
        .select(
            "label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "first").alias("component"),
        )
    )
    # one vector may stand in very many rows
    copies = folded.df.select("label", "vec", "weight")
    told = join_hot(good, found, ["label", "vec"], "vec_id", copies, rows.df.count(), "weight").select("vec_id", "links", "component")
    alone = rows.df.filter("vec is null or vec_id is null").select("vec_id", F.lit(None).cast("bigint").alias("links"), F.lit(None).cast("bigint").alias("component"))
    whole = told.unionByName(alone)
    component = F.coalesce("component", "vec_id")
    return whole.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
