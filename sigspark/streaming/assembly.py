"""Traces assembled from a stream of steps that arrive in any order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

TRACE = "trace_id long, first timestamp, last timestamp, n long, mean array<double>, std array<double>, dwell array<double>"
_STATE = "event_id array<long>, micros array<long>, mean array<double>, std array<double>"


def assemble(steps: DataFrame, gap: str = "1 hour", late: str = "1 hour", last_dwell: float = 1.0) -> DataFrame:
    """Closed traces (trace_id, first, last, n, mean, std, dwell) of a stream of steps (trace_id, event_id, ts, mean, std).

    A trace stays open, in state, until the watermark (`late` behind the newest time seen) is more than `gap` past its last step; then
    it is sorted by time and event and given out once: dwell is the time to the next step in seconds, and last_dwell for the
    last one. A row that arrives behind the watermark (Spark takes that of the batch before) is left out, and counted by `late_rows`; a step more than `gap` after a closed
    trace's last one begins another trace of that id. Rows without an id or a time are left out; null levels stay null. State holds
    the steps of open traces, so it grows with what is open at a time and not with the stream.
    """
    span = int(pd.Timedelta(gap).total_seconds() * 1000)

    def close(key, state):
        event, micros, mean, std = (np.array(x, object) for x in state)
        order = np.lexsort((event.astype(np.int64), micros.astype(np.int64)))
        micros = micros.astype(np.int64)[order]
        parts = np.split(np.arange(len(order)), np.flatnonzero(np.diff(micros) > span * 1000) + 1)
        for own in parts:
            at = order[own]
            dwell = [*(np.diff(micros[own]) / 1e6).tolist(), last_dwell]
            yield (key, pd.Timestamp(micros[own[0]], unit="us"), pd.Timestamp(micros[own[-1]], unit="us"), len(own), mean[at].tolist(), std[at].tolist(), dwell)

    def update(key, frames, state):
        if state.hasTimedOut:
            rows = list(close(key[0], state.get))
            state.remove()
            yield pd.DataFrame(rows, columns=["trace_id", "first", "last", "n", "mean", "std", "dwell"])
            return
        held = [list(x) for x in state.get] if state.exists else [[], [], [], []]
        for frame in frames:
            for own, c in zip(held, ("event_id", "micros", "mean", "std")):
                own.extend(None if x != x else x for x in frame[c].tolist())
        state.update(tuple(held))
        state.setTimeoutTimestamp(max(held[1]) // 1000 + span)

    rows = steps.where("trace_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select(F.col("trace_id").cast("long").alias("trace_id"), F.col("event_id").cast("long").alias("event_id"), "ts", F.unix_micros("ts").alias("micros"), F.col("mean").cast("double").alias("mean"), F.col("std").cast("double").alias("std"))
    return rows.groupBy("trace_id").applyInPandasWithState(update, TRACE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(query) -> int:
    """Rows that a query has left out as late since it started, of the batches that its progress still tells of."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
