"""Fill-in-the-middle examples: every document is cut at two places that its id decides, and its parts are put in another order.

A text's units are runs of ASCII letters and single other characters.  The regex library walks over them and leaves the place
where each ends in one compact array, so cutting a text takes two look-ups and three slices.  The cuts and the form come from
the SHA-256 of the seed and the decimal id: the first two numbers choose the cuts, the third leaves some documents plain, and the
fourth picks between the orders prefix, suffix, middle (``psm``) and suffix, prefix, middle (``spm``).

The work is one Arrow-batched pandas UDF, a narrow pass without a shuffle: rows don't depend on each other, so a lost executor
costs its own partitions only, and memory is bounded by a batch.

Defined cases: a null text counts as empty; an empty text, and one that contains a marker, stays plain; a null doc_id counts as
an empty number; rows that share a doc_id are cut by the same hash, each by its own length; repeated rows give a row each; cuts may
coincide, which leaves the middle empty; the length of a text isn't limited; an empty table gives an empty result; other columns of
the input aren't read, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKERS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
SEED = "1"
CUT_PERCENT = 90  # of the documents that are cut
SPM_PERCENT = 20  # of those, the part whose suffix comes first
UNIT = regex.compile("[A-Za-z]+|[^A-Za-z]")


def unit_ends(text: str) -> np.ndarray:
    """Where each unit of a text ends, in code points."""
    return np.fromiter((m.end() for m in UNIT.finditer(text)), np.uint32)


def numbers_of(doc_id: str, seed: str = SEED) -> list[int]:
    """The first four numbers of 32 bits in the hash of a document's id."""
    digest = sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id: str, text: str | None, seed: str = SEED, cut: int = CUT_PERCENT, spm: int = SPM_PERCENT, markers: tuple[str, str, str] = MARKERS) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    text = text or ""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = numbers_of(doc_id, seed)
    if not text or h3 % 100 >= cut or any(m in text for m in markers):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    prefix, middle, suffix = (mark + part for mark, part in zip((markers[0], markers[2], markers[1]), (text[:a], text[a:b], text[b:])))
    if h4 % 100 < spm:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def restored(output: str, form: str, markers: tuple[str, str, str] = MARKERS) -> str:
    """The text that an output was made of, from the output and its form alone."""
    if form == "plain":
        return output
    first, second = (markers[1], markers[0]) if form == "spm" else markers[:2]
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(markers[2], 1)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def _check(markers: tuple[str, str, str]) -> None:
    """A marker must begin with a sign that no marker has again, or a text's end could complete one."""
    if len(set(markers)) < 3 or not all(markers) or any(m[0] in other[1:] for m in markers for other in markers):
        raise ValueError("markers must differ, and their first signs must not stand inside a marker")


def fill_in_middle(docs: DataFrame, seed: str = SEED, cut: int = CUT_PERCENT, spm: int = SPM_PERCENT, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``doc_id, n`` (units) ``, form, prefix_chars, middle_chars, output`` for each row of ``docs(doc_id, text)``."""
    _check(markers)

    @F.pandas_udf("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    def arranged(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [rearranged(i, t, seed, cut, spm, markers) for i, t in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    made = arranged(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))
    return docs.select("doc_id", made.alias("made")).select("doc_id", "made.*")


def with_digests(examples: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Replaces ``output`` by ``output_sha256`` and by ``restored_sha256``, the digest of the text rebuilt from output and form."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def digests(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        pairs = [tuple(sha256(s.encode()).hexdigest() for s in (o, restored(o, f, markers))) for o, f in zip(outputs, forms)]
        return pd.DataFrame(pairs, columns=["output_sha256", "restored_sha256"])

    kept = [c for c in examples.columns if c != "output"]
    return examples.select(*kept, digests("output", "form").alias("sha")).select(*kept, "sha.*")
