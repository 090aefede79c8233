"""Sliding-window rate limiting (P3): denied hits are not recorded.

Batch form: hits are cut into runs where nothing before can matter.  That is so after a
silence longer than the window, and at a hit from which on, for a whole window, every
hit is *free*: no more than ``limit`` hits, denied ones included, lie in the window
before it, so it is allowed whatever was decided earlier.  Runs are found per key and
time slice with small per-slice summaries, so a key that is never silent spreads over
its slices; each run is then decided in time order holding only the last accepted
times.  Only a key above its limit all the time stays one run.  The streaming form
keeps the same list as state per key, and drops it when the key has been idle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

WINDOW_SECONDS = 60
SLICE_WINDOWS = 60
IDLE_SECONDS = 24 * 3600


def verdicts(times: list[int], limit: int, window_us: int, recent: list[int] | None = None) -> tuple[list[bool], list[int]]:
    """Decisions on hits in time order, and the last accepted times, oldest first.

    Only the ``limit`` latest accepted times matter: a hit is allowed when the oldest of them
    has left the window.  They sit in a ring whose place ``at`` holds the oldest.
    """
    never = -(1 << 62)
    recent = recent or []
    ring, at, allowed = [never] * (limit - len(recent)) + list(recent), 0, []
    for now in times:
        free = limit > 0 and ring[at] < now - window_us
        if free:
            ring[at], at = now, (at + 1) % limit
        allowed.append(free)
    return allowed, [t for t in ring[at:] + ring[:at] if t != never]


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _decide(limit: int, window_us: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = None, []
        for rows in batches:
            allowed = []
            for run_key, part in rows.groupby(["key", "run_start"], sort=False, dropna=False):
                decided, recent = verdicts(part["us"].tolist(), limit, window_us, recent if run_key == last else [])
                allowed += decided
                last = run_key
            yield pd.DataFrame({"key": rows["key"], "event_id": rows["event_id"], "allowed": allowed})

    return run


def limiter_runs(hits: DataFrame, limit: int, window_us: int) -> DataFrame:
    """``key, event_id, us`` with the start of the run each hit belongs to.

    A slice opens at most one run by free hits; silences open as many as there are.
    """
    slice_us = window_us * SLICE_WINDOWS
    sliced = hits.withColumn("_slice", F.floor(F.col("us") / slice_us).cast("bigint"))
    begin = F.col("_slice") * slice_us
    closing = F.count(F.when(F.col("us") >= begin + slice_us - window_us, 1))
    ends = sliced.groupBy("key", "_slice").agg(F.max("us").alias("_last"), closing.alias("_closing"))
    in_order = Window.partitionBy("key").orderBy("_slice")
    adjacent = F.lag("_slice").over(in_order) == F.col("_slice") - 1
    before = ends.select(
        "key", "_slice", F.lag("_last").over(in_order).alias("_before"),
        F.when(adjacent, F.lag("_closing").over(in_order)).otherwise(0).alias("_carried_hits"),
    )
    w = Window.partitionBy("key", "_slice").orderBy("us", "event_id")
    gap = F.col("us") - F.coalesce(F.lag("us").over(w), F.col("_before"))
    # Without ``limit`` earlier hits in the slice, those that close the slice before are added.
    few = (F.col("us") - begin > window_us) | (F.row_number().over(w) + F.col("_carried_hits") <= limit)
    free = F.coalesce(F.lag("us", limit).over(w) < F.col("us") - window_us, few)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    clear = (F.col("us") + window_us < begin + slice_us) & F.coalesce(
        F.min(F.when(~F.col("_free"), F.col("us"))).over(ahead) > F.col("us") + window_us, F.lit(True)
    )
    opening = F.min(F.when(F.col("_clear"), F.col("us"))).over(Window.partitionBy("key", "_slice"))
    marked = (
        sliced.join(before, ["key", "_slice"])
        .withColumns({"_silent": F.coalesce(gap > window_us, F.lit(True)), "_free": free})
        .withColumn("_clear", clear)
        .withColumn("_start", F.when(F.col("_silent") | F.coalesce(F.col("us") == opening, F.lit(False)), F.col("us")))
    )
    starts = marked.groupBy("key", "_slice").agg(F.max("_start").alias("_last_start"))
    carried = starts.select(
        "key", "_slice",
        F.last("_last_start", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"),
    )
    own = F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(carried, ["key", "_slice"]).select(
        "key", "event_id", "us", F.coalesce(own, F.col("_carried")).alias("run_start")
    )


def limit_hits(hits: DataFrame, limit: int, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``key, event_id, allowed`` for ``hits(key, event_id, ts)``."""
    window_us = window_seconds * 1_000_000
    rows = hits.select("key", "event_id", _micros(F.col("ts")).alias("us"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return (
        limiter_runs(rows, limit, window_us).repartition("key", "run_start").sortWithinPartitions("key", "run_start", "us", "event_id")
        .select("key", "run_start", "us", "event_id")
        .mapInPandas(_decide(limit, window_us), f"key {kinds['key']}, event_id {kinds['event_id']}, allowed boolean")
    )


STATE = "times array<bigint>, newest bigint, touched bigint"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """The accepted times of a key, its newest hit, and when it was last seen by the wall clock.

    A timer looks at every key once an idle period.  It forgets a key not seen for that long,
    unless the timer itself is overdue by as much: then the query stood still, hits may be
    waiting in the source, and the key gets another period.
    """

    def __init__(self, limit: int, window_us: int, delay_us: int, idle_ms: int):
        self.limit, self.window_us, self.delay_us, self.idle_ms = limit, window_us, delay_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits = pd.concat([part[["us", "event_id"]] for part in rows]).sort_values(["us", "event_id"])
        now = int(timerValues.getCurrentProcessingTimeInMs())
        state = self.kept.get()
        if state is None:
            self.handle.registerTimer(now + self.idle_ms)
        recent, newest = (list(state[0]), state[1]) if state else ([], None)
        times = hits["us"].to_numpy()
        late = times < (times[0] if newest is None else newest - self.delay_us)
        allowed, recent = verdicts(times[~late].tolist(), self.limit, self.window_us, recent)
        decision = np.full(len(times), "late", object)
        decision[~late] = np.where(allowed, "allow", "deny")
        self.kept.update((recent, int(times[-1] if newest is None else max(newest, times[-1])), now))
        yield pd.DataFrame({"key": key[0], "event_id": hits["event_id"].to_numpy(), "decision": decision})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs())
        state = self.kept.get()
        if state is not None:
            due = state[2] + self.idle_ms
            if due <= now and now - int(expiredTimerInfo.getExpiryTimeInMs()) < self.idle_ms:
                self.kept.clear()
            else:
                self.handle.registerTimer(due if due > now else now + self.idle_ms)
        return iter([])

    def close(self) -> None:
        pass


def limit_stream(
    hits: DataFrame, limit: int, window_seconds: int = WINDOW_SECONDS, delay_seconds: int | None = None, idle_seconds: int | None = None,
) -> DataFrame:
    """Streaming form over event time: ``key, event_id, decision``.

    State is at most ``limit + 2`` numbers per key, and only of keys seen in the last
    ``idle_seconds`` of the wall clock (a day, or window and delay if longer; triggers must be
    more frequent).  Every hit is answered: one older than the key's newest by more than the
    delay is marked ``late`` and not counted; :func:`late_hits` is the side output.  Spark's
    watermark is not used, as it drops late rows and a dropped hit has no answer.

    The timers ask for batches for ever, so a run over what is available needs
    ``run_to_files(..., timers=True)``.  They need the RocksDB state store, which this sets for queries the session starts from
    here on; queries with a checkpoint keep the store they began with.
    """
    delay_seconds = delay_seconds or window_seconds
    idle_seconds = idle_seconds or max(IDLE_SECONDS, window_seconds + delay_seconds)
    hits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = hits.select("key", "event_id", _micros(F.col("ts")).alias("us"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Limiter(limit, window_seconds * 1_000_000, delay_seconds * 1_000_000, idle_seconds * 1000),
        outputStructType=f"key {kinds['key']}, event_id {kinds['event_id']}, decision string",
        outputMode="append", timeMode="processingTime",
    )


def late_hits(decided: DataFrame) -> DataFrame:
    """The hits of a decided stream that came too late to count."""
    return decided.filter("decision = 'late'").drop("decision")
