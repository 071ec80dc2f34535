"""Paged collections told from their pages: how far each went, why it stopped, and what of it counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page_outcomes(pages: DataFrame, scope: str, page: str, status: str, entries: str, fingerprint: str, has_next: str | None = None, limit: int | None = None) -> DataFrame:
    """``pages`` with ``event`` (why a collection would stop here, null if it goes on) and ``kept`` (whether the page's entries count).

    Pages count from 0 without a gap; what lies behind a gap or the ``limit`` was never reached.  Events, the first that holds:
    ``failed`` (status isn't ``ok``), ``empty_page``, ``repeated_page`` (an earlier page of the scope had the same fingerprint), ``no_next_page`` (with
    ``has_next``; the page itself counts).  Entries count up to the first event; a page that stands twice counts once.
    """
    one = pages.groupBy(scope, page).agg(F.min(F.struct(status, entries, fingerprint, *([has_next] if has_next else []))).alias("_x")).select(scope, page, "_x.*")
    order = W.partitionBy(scope).orderBy(page)
    again = F.row_number().over(W.partitionBy(scope, fingerprint).orderBy(page)) > 1
    event = F.when(F.col(status) != "ok", "failed").when(F.col(entries) == 0, "empty_page").when(F.col("_again"), "repeated_page")
    event = event if has_next is None else event.when(~F.coalesce(has_next, F.lit(False)), "no_next_page")
    told = one.withColumn("_again", again).withColumn("_n", F.row_number().over(order) - 1)
    told = told.filter((F.col("_n") == F.col(page)) & (F.lit(True) if limit is None else F.col(page) < limit)).withColumn("event", event)
    before = F.count("event").over(order.rowsBetween(W.unboundedPreceding, -1))
    kept = (F.col("_before") == 0) & (F.col("event").isNull() | (F.col("event") == "no_next_page"))
    return told.withColumn("_before", before).withColumn("kept", kept).drop("_again", "_n")


def collection_status(outcomes: DataFrame, scope: str, page: str, entries: str, limit: int | None = None, auto: bool = True) -> DataFrame:
    """``scope, status, stop_reason, pages_completed, failed_page, n_entries, complete`` of each scope.

    A failure after some pages leaves a ``partial`` collection whose pages are kept, one on the first page is ``fetch_failed``.  In ``auto`` mode a
    collection that reaches the ``limit`` without a reason to stop is ``partial`` too (``hard_limit_reached``).  ``failed_page`` counts from 1.
    """
    first = outcomes.filter("_before = 0")
    g = first.groupBy(scope).agg(
        F.max("event").alias("event"),
        F.count_if(F.coalesce(F.col("event") != "failed", F.lit(True))).alias("pages_completed"),
        F.max(F.when(F.col("event") == "failed", F.col(page) + 1)).alias("failed_page"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col(entries))), F.lit(0)).alias("n_entries"),
    )
    at_limit = F.lit(False) if limit is None else (F.col("pages_completed") >= limit)
    cut_off = at_limit & F.col("event").isNull() & F.lit(auto)
    failed = F.coalesce(F.col("event") == "failed", F.lit(False))
    status = F.when(failed & (F.col("pages_completed") == 0), "fetch_failed").when(failed | cut_off, "partial").when(F.col("n_entries") > 0, "collected").otherwise("ok")
    reason = F.when(failed, None).when(cut_off, "hard_limit_reached").otherwise(F.col("event"))
    complete = ~failed & ~cut_off & (F.col("event").isNotNull() | (F.lit(not auto) & at_limit))
    return g.select(scope, status.alias("status"), reason.alias("stop_reason"), "pages_completed", "failed_page", "n_entries", complete.alias("complete"))


def recovered(candidates: DataFrame, outcomes: DataFrame, scope: str, page: str, key: str, order: list[str]) -> DataFrame:
    """The candidates of pages that count, each id once: the first by page and ``order``."""
    rows = candidates.join(outcomes.filter("kept").select(scope, page), [scope, page], "left_semi")
    rest = [c for c in candidates.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(page, *order)).alias("_f"))
    return first.select(key, "_f.*").select(*candidates.columns)
