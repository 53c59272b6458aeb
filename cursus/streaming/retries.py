"""A retry queue as state by key: failures wait, come back a bounded number of times, and end when they succeed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.remote import failure_kind

OUT = "video_id string, attempts int, action string"


def retry_queue(attempts: DataFrame, most: int = 2, wait_ms: int = 5000) -> DataFrame:
    """(video_id, attempts, action) from a stream of (video_id, ok, error): retry when a failure's wait is over, and
    skipped when it is permanent or the attempts are spent. A success ends the key's state."""
    rows = attempts.select(F.col("video_id").cast("string").alias("video_id"), "ok", failure_kind(F.col("error")).alias("kind"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made = lambda n, action: pd.DataFrame({"video_id": [key[0]], "attempts": [n], "action": [action]})
        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.update((n,))
            yield made(n, "retry")
            return
        for frame in frames:
            for ok, kind in zip(frame["ok"], frame["kind"], strict=True):
                if ok:
                    n = 0
                    if state.exists:
                        state.remove()
                elif kind == "permanent" or n >= most:
                    yield made(n, "skipped")
                    n = 0
                    if state.exists:
                        state.remove()
                else:
                    n += 1
                    state.update((n,))
        if n:
            state.setTimeoutDuration(wait_ms)

    return rows.groupBy("video_id").applyInPandasWithState(step, OUT, "attempts int", "append", GroupStateTimeout.ProcessingTimeTimeout)


class RetryProcessor(StatefulProcessor):
    """Failures by key as state that expires, and a timer by the clock for each that waits.

    A failure is answered with wait, and with retry once its timer fires; a permanent one, or one beyond `most`, with skipped.
    A success forgets the failures. A key that nothing has come for in keep_ms is forgotten as well.
    """

    def __init__(self, most: int, wait_ms: int, keep_ms: int):
        self.most, self.wait_ms, self.keep_ms = most, wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("failures", "attempts int, permanent boolean", self.keep_ms)

    def _answer(self, key: tuple, n: int, action: str) -> pd.DataFrame:
        return pd.DataFrame({"video_id": [key[0]], "attempts": [n], "action": [action]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        n, permanent = self.state.get() if self.state.exists() else (0, False)
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            n, permanent = (0, False) if r.ok else (n + 1, permanent or r.kind == "permanent")
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not n:
            self.state.clear()
            return
        self.state.update((n, permanent))
        if permanent or n > self.most:
            yield self._answer(key, n, "skipped")
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            yield self._answer(key, n, "wait")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            yield self._answer(key, self.state.get()[0], "retry")

    def close(self) -> None:
        pass


#: What a stream with such state needs of its session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def retry_stream(attempts: DataFrame, most: int = 2, wait_ms: int = 5000, keep_ms: int = 86_400_000) -> DataFrame:
    """(video_id, attempts, action), each change of what is to be done, from a stream of (video_id, at, ok, error); the last row
    of a key says what retry_table says of it. The session's state store must be that of STATE_STORE."""
    rows = attempts.select(F.col("video_id").cast("string").alias("video_id"), "at", F.coalesce("ok", F.lit(False)).alias("ok"), failure_kind(F.col("error")).alias("kind"))
    return rows.groupBy("video_id").transformWithStateInPandas(RetryProcessor(most, wait_ms, keep_ms), OUT, "Append", "ProcessingTime")


def retry_table(attempts: DataFrame, now: str, most: int = 2, wait_s: int = 5) -> DataFrame:
    """The same from a table of all attempts (video_id, at, ok, error): failures since the last success, and what to do
    at the time `now`."""
    done = attempts.groupBy("video_id").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("__done"))
    open_ = attempts.join(done, "video_id").where(~F.col("ok") & (F.col("__done").isNull() | (F.col("at") > F.col("__done"))))
    out = open_.groupBy("video_id").agg(F.count("*").cast("int").alias("attempts"), F.max("at").alias("__at"), F.bool_or(failure_kind(F.col("error")) == "permanent").alias("__permanent"))
    ready = F.col("__at") + F.make_dt_interval(secs=F.lit(wait_s)) < F.lit(now).cast("timestamp")
    action = F.when(F.col("__permanent") | (F.col("attempts") > most), "skipped").when(ready, "retry").otherwise("wait")
    return out.select("video_id", "attempts", action.alias("action"))


def breaker(attempts: DataFrame, key: str, order: str, ok: str, pause_every: int = 5, stop_at: int = 50) -> DataFrame:
    """Attempts with the failures in a row up to each, and whether to go on, pause or stop after it."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = attempts.withColumn("__run", F.sum(F.col(ok).cast("int")).over(w))
    inside = Window.partitionBy(key, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    failed = F.sum((~F.col(ok)).cast("int")).over(inside)
    advice = F.when(F.col("failures") >= stop_at, "stop").when((F.col("failures") > 0) & (F.col("failures") % pause_every == 0), "pause").otherwise("go on")
    return runs.withColumn("failures", failed).withColumn("advice", advice).drop("__run")


def not_done(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left after a break."""
    return ids.join(done.select(key).distinct(), key, "left_anti")
