"""Jobs that survive a restart: their statuses as the state of a stream, and the same rules for a table of jobs.

A job is ``pending``, ``running``, ``completed`` or ``failed``.  A submission makes it pending, unless it is completed for the same input; a
start makes a pending or failed job running and counts an attempt; ``done`` and ``fail`` end a running job.  Other events are refused and
change nothing.  A job that an earlier run left running counts as pending: nobody works on it any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .quota import rocksdb_state

NEW = ("", "", 0, "")  # status, input hash, attempts, run


def advance(state: tuple[str, str, int, str], kind: str, digest: str | None, run: str) -> tuple[tuple[str, str, int, str], bool]:
    """The state after an event, and whether the event was refused."""
    status, held, attempts, last_run = state
    if status == "running" and last_run != run:
        status = "pending"
    now = (status, held, attempts, run)
    if kind == "submit" and status != "running":
        if status == "completed" and held == (digest or ""):
            return now, False
        return ("pending", digest or "", attempts if held == (digest or "") else 0, run), False
    if kind == "start" and status in ("pending", "failed"):
        return ("running", held, attempts + 1, run), False
    if kind in ("done", "fail") and status == "running":
        return ("completed" if kind == "done" else "failed", held, attempts, run), False
    return now, True


class _Jobs(StatefulProcessor):
    def __init__(self, job: str, order: str, kind: str, digest: str, run: str):
        self.job, self.order, self.kind, self.digest, self.run = job, order, kind, digest, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, input_hash string, attempts int, run string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values([self.order])
        state = tuple(self.state.get()) if self.state.exists() else NEW
        out = []
        for kind, digest in zip(events[self.kind], events[self.digest]):
            state, refused = advance(state, kind, digest, self.run)
            out.append((state[0] or None, state[2], refused))
        self.state.update(state)
        told = pd.DataFrame(out, columns=["status", "attempts", "refused"])
        told.insert(0, self.order, events[self.order].to_numpy())
        told.insert(0, self.job, events[self.job].to_numpy())
        yield told

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, run: str, job: str = "job_id", order: str = "event_id", kind: str = "kind", digest: str = "input_hash") -> DataFrame:
    """``job, order, status, attempts, refused`` for each event of a stream, by job in order; ``run`` names this start of the stream.

    The state of a job is one value and is kept with the checkpoint, so a stream that is started again with another ``run`` goes on where it
    stopped and takes jobs that the last run left running as pending.
    """
    rocksdb_state(events.sparkSession)
    kind_j, kind_o = (events.schema[c].dataType.simpleString() for c in (job, order))
    slim = events.select(job, order, kind, digest)
    return slim.groupBy(job).transformWithStateInPandas(_Jobs(job, order, kind, digest, run), f"{job} {kind_j}, {order} {kind_o}, status string, attempts int, refused boolean", "update", "None")


def reset_running(jobs: DataFrame, status: str = "status", stale: Column | None = None) -> DataFrame:
    """A table of jobs as a new run finds it: running ones (or those of them that ``stale`` names) are pending again."""
    left = F.col(status) == "running"
    left = left if stale is None else left & F.coalesce(stale, F.lit(False))
    return jobs.withColumn(status, F.when(left, "pending").otherwise(F.col(status)))
