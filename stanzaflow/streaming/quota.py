"""Stateful streams: a sliding quota, idempotent first rows, and batch-wise merges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT = 20
SPAN_S = 60.0


def accept(times: list[float], accepted: list[float], limit: int = LIMIT, span: float = SPAN_S) -> tuple[list[bool], list[float]]:
    """Which calls a sliding quota lets through.  Rejected calls leave no trace; one is forgotten once ``t <= now - span``."""
    out = []
    for now in times:
        accepted = [t for t in accepted if t > now - span]
        ok = len(accepted) < limit
        if ok:
            accepted.append(now)
        out.append(ok)
    return out, accepted


def quota_decisions(calls: DataFrame, client: str = "user_id", event: str = "event_id", ts: str = "ts", limit: int = LIMIT, span: float = SPAN_S) -> DataFrame:
    """``client, event, allowed`` of a batch of calls, by client in time order.

    Whether a call counts depends on the decisions before it, so no window aggregate can express it.  A client's calls
    are cut where a pause is as long as the span: nothing is remembered over it, so the pieces are decided on their own.
    The pauses are found by a window over slim rows of a client, and a client without a pause is one piece.
    """
    from pyspark.sql import Window as W

    kind_c, kind_e = (calls.schema[c].dataType.simpleString() for c in (client, event))
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    order = W.partitionBy(client).orderBy("seconds", event)
    timed = calls.select(F.col(client), F.col(event), t.alias("seconds"))
    fresh = F.coalesce((F.col("seconds") - F.lag("seconds").over(order) >= span).cast("int"), F.lit(1))
    pieces = timed.withColumn("_new", fresh).withColumn("_piece", F.sum("_new").over(order))

    def decided(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seconds", event])
        pdf["allowed"] = accept(pdf["seconds"].tolist(), [], limit, span)[0]
        return pdf[[client, event, "allowed"]]

    return pieces.groupBy(client, "_piece").applyInPandas(decided, f"{client} {kind_c}, {event} {kind_e}, allowed boolean")


def rocksdb_state(spark) -> None:
    """State with lists and timers needs Spark's RocksDB store; a store that the user has chosen stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key, "HDFSBacked"):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Quota(StatefulProcessor):
    """A client's state is the list of the times of its accepted calls; a timer forgets it once the last of them no longer counts."""

    def __init__(self, client: str, event: str, limit: int, span: float):
        self.client, self.event, self.limit, self.span = client, event, limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("accepted", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["seconds", self.event])
        ok, kept = accept(calls["seconds"].tolist(), [x[0] for x in self.times.get()], self.limit, self.span)
        self._remember(kept)
        yield pd.DataFrame({self.client: calls[self.client].to_numpy(), self.event: calls[self.event].to_numpy(), "allowed": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        self._remember([x[0] for x in self.times.get() if x[0] > now - self.span])
        return iter(())

    def _remember(self, kept: list[float]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not kept:
            self.times.clear()
            return
        self.times.put([(t,) for t in kept])
        self.handle.registerTimer(int((max(kept) + self.span) * 1000) + 1)

    def close(self) -> None:
        pass


def quota_stream(calls: DataFrame, client: str = "user_id", event: str = "event_id", ts: str = "ts", limit: int = LIMIT, span: float = SPAN_S, late: str = "1 minute") -> DataFrame:
    """The same over a stream, with a list of times as the state of a client.

    Calls may come ``late`` by event time; later ones are dropped, as Spark drops them.  Once the watermark has passed the last accepted call by
    the span a timer clears the client's state, so clients that stay away cost nothing.
    """
    rocksdb_state(calls.sparkSession)
    kind_c, kind_e = (calls.schema[c].dataType.simpleString() for c in (client, event))
    timed = calls.withWatermark(ts, late).select(F.col(client), F.col(event), F.col(ts), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("seconds"))
    return timed.groupBy(client).transformWithStateInPandas(_Quota(client, event, limit, span), f"{client} {kind_c}, {event} {kind_e}, allowed boolean", "append", "eventTime")


def first_by_key(stream: DataFrame, keys: list[str], ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """Exactly one row for each key; with an event time the state is bounded by a watermark."""
    if ts is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def merge_batches(stream: DataFrame, root: str, merge, checkpoint: str):
    """Merge each micro-batch into a versioned table: ``merge(old, batch) -> new``; an unchanged result isn't published."""
    from ..sources import readers, writers

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        old = readers.read_latest(spark, root) if writers.latest(spark, root) is not None else None
        writers.publish(merge(old, batch) if old is not None else batch, root)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: counts by tumbling window with a watermark for late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
