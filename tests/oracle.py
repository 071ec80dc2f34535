"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import math
import pathlib

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if pathlib.Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def _family(v) -> str:
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(v), type(v).__name__)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """What differs, or nothing."""
    cur = con.execute(sql)
    c2, r2 = rows([d[0] for d in cur.description], cur.fetchall())
    c1, r1 = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if c1 != c2:
        return f"columns {c1} and {c2}"
    if len(r1) != len(r2):
        return f"{len(r1)} rows and {len(r2)}"
    for a, b in zip(r1, r2):
        if a != b:
            return f"{a} and {b}"
        for x, y in zip(a, b):
            if x is not None and y is not None and _family(x) != _family(y):
                return f"kinds of {x!r} and {y!r}"
    return None
