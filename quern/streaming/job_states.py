"""Each job's moves as a stream with keyed state: which changes are allowed, in order of event time, and which jobs hang.

Changes may come late, repeated and out of order. A row waits in its job's state until the watermark has passed it; then no
earlier one can come, and it is judged against the row before. So the stream gives what jobs.transitions gives on the whole
table, row for row. State per job is its last row and the rows not yet judged. The session needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.operators.jobs import FOLLOWS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMED_OUT = "timed out"
_ZERO = pd.Timestamp(0)


def _micros(ts: pd.Timestamp) -> int:
    return (ts - _ZERO) // pd.Timedelta(microseconds=1)


def _allowed(before: str | None, state: str | None) -> bool:
    return state == "created" if before is None else before in FOLLOWS.get(state, [])


class JobStates(StatefulProcessor):
    """last: the newest row judged. waiting: rows not yet judged, by (time in microseconds, seq), so that repeats fall together."""

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, at long, seq long")
        self.waiting = handle.getMapState("waiting", "at long, seq long", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        soonest = None
        for pdf in rows:
            for state, ts, seq in zip(pdf["state"], pdf["ts"], pdf["seq"]):
                at = (_micros(ts), int(seq))
                if last is None or at > (last[1], last[2]):
                    self.waiting.updateValue(at, (state,))
                    soonest = at[0] if soonest is None else min(soonest, at[0])
        if soonest is not None:
            self.handle.registerTimer(soonest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed is due; a job has one timer, for the first of the rows that still wait.
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [(tuple(k), v[0]) for k, v in self.waiting.iterator()]
        due = sorted((r for r in rows if r[0][0] < until), key=lambda r: r[0])
        last = self.last.get() if self.last.exists() else None
        out = []
        for at, state in due:
            out.append((state, *at, last[0] if last else None, _allowed(last[0] if last else None, state), None))
            last = (state, *at)
            self.waiting.removeKey(at)
        if len(due) < len(rows):
            self.handle.registerTimer(min(at for (at, _), _ in rows if at >= until) // 1000 + 1)
        if self.timeout_ms is not None and last and last[0] == "processing":
            ends = last[1] // 1000 + self.timeout_ms + 1
            if due and until < ends * 1000:
                self.handle.registerTimer(ends)
            elif until >= ends * 1000:
                out.append(("failed", ends * 1000, last[2], last[0], True, TIMED_OUT))
                last = ("failed", ends * 1000, last[2])
        if out:
            self.last.update(tuple(last))
            yield pd.DataFrame({"key": [key[0]] * len(out), "state": [r[0] for r in out], "ts": pd.to_datetime([r[1] for r in out], unit="us"), "seq": [r[2] for r in out], "before": [r[3] for r in out], "allowed": [r[4] for r in out], "reason": [r[5] for r in out]})


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def judged_changes(changes: DataFrame, key: str, state: str, ts: str, seq: str, late: str = "2 hours", timeout_ms: int | None = None) -> DataFrame:
    """key, state, ts, seq, before, allowed, reason of a stream of changes; append mode.

    seq (long) tells changes of one time apart, and repeats of one change share it. Rows that come later than late behind the
    newest are left out, and so are rows without key, ts or seq. With timeout_ms, a job that is processing for so long without a
    further change fails: a row of its own with the reason TIMED_OUT.
    """
    use_state_store(changes.sparkSession)
    rows = changes.select(F.col(key).alias("key"), F.col(state).alias("state"), F.col(ts).cast("timestamp").alias("ts"), F.col(seq).cast("long").alias("seq"))
    rows = rows.dropna(subset=["key", "ts", "seq"]).withWatermark("ts", late)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, state string, ts timestamp, seq long, before string, allowed boolean, reason string"
    judged = rows.groupBy("key").transformWithStateInPandas(JobStates(timeout_ms), schema, "append", "eventTime")
    return judged.withColumnsRenamed({"key": key, "state": state, "ts": ts, "seq": seq})
