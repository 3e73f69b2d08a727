"""Keyed state with event-time timers, and asks joined with what became of them.

The processors keep one value for each key and give it back when the watermark has passed its
last use, so state holds only what is open. Rows of one key and trigger are put in order of their
time; a later trigger's rows are later than those before, up to the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.state import BUDGET_LIMIT, BUDGET_WINDOW, GUARD_TTL, Guard, guard_step

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # runs are few and large: each begins at a stored snapshot, where a log of changes would be played again from its start
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    # a row is written without a look at whether it is new
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # a join keeps its four tables in one store for each partition
    "spark.sql.streaming.join.stateFormatVersion": "3",
}
DELAY = "1 minute"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that value state and timers need, for the streams started inside."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class BudgetProcessor(StatefulProcessor):
    """Requests of a key counted into the window that its first request opens."""

    def __init__(self, key: str, limit: int, window: int) -> None:
        self.key, self.limit, self.window = key, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, requests bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for frame in rows for t in frame["second"].tolist())
        held, requests = self.open.get() or (None, 0)
        start = held
        done = []
        for t in times:
            if start is None or t - start > self.window:
                if start is not None:
                    done.append((start, requests))
                start, requests = t, 0
            requests += 1
        self.open.update((start, requests))
        if start != held:
            # one timer for the window left open, not one for each that the rows went through:
            # the first instant at which no request can belong to it any more
            self.handle.registerTimer((start + self.window + 1) * 1000)
        out = pd.DataFrame([*done, (start, requests)], columns=["window_start", "requests"])
        out.insert(0, self.key, key[0])
        out["allowed"] = out["requests"].clip(upper=self.limit)
        out["denied"] = out["requests"] - out["allowed"]
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        if held is not None and (held[0] + self.window + 1) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def budget_stream(requests: DataFrame, key: str, ts: str, limit: int = BUDGET_LIMIT, window: int = BUDGET_WINDOW, delay: str = DELAY) -> DataFrame:
    """Budget windows of a stream of requests, in update mode: ``(key, window_start, requests, allowed, denied)``.

    The last row of a window is its result. A window's state goes when the watermark passes it.
    """
    kind = requests.schema[key].dataType.simpleString()
    rows = requests.select(key, ts, F.unix_seconds(ts).alias("second")).withWatermark(ts, delay)
    return rows.groupBy(key).transformWithStateInPandas(
        BudgetProcessor(key, limit, window), f"{key} {kind}, window_start bigint, requests bigint, allowed bigint, denied bigint", "Update", "EventTime")


class GuardProcessor(StatefulProcessor):
    """Loop guard whose entries are forgotten for good when they are older than ``ttl``."""

    def __init__(self, names: tuple[str, str, str], ttl: int) -> None:
        (self.key, self.seq, self.event), self.ttl = names, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "opened double, retries int, waiting boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["second", self.seq])
        held = self.entry.get()
        state = Guard(*held) if held is not None else None
        outcomes, retries = [], []
        for at, what in zip(frame["second"].tolist(), frame[self.event].tolist()):
            if state is not None and at - state.opened > self.ttl:
                state = None
            state, outcome = guard_step(state, what, at, self.ttl)
            outcomes.append(outcome)
            retries.append(state.retries if state else 0)
        if state is None:
            self.entry.clear()
        else:
            self.entry.update((state.opened, state.retries, state.waiting))
            if held is None or state.opened != held[0]:
                # one timer for the entry that stays, none for those forgotten on the way
                self.handle.registerTimer(int((state.opened + self.ttl + 1) * 1000))
        yield pd.DataFrame({self.key: key[0], self.seq: frame[self.seq].tolist(), "outcome": outcomes, "retries": retries})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get()
        if held is not None and (held[0] + self.ttl + 1) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_guard(events: DataFrame, key: str, seq: str, ts: str, event: str, ttl: int = GUARD_TTL, delay: str = DELAY) -> DataFrame:
    """Outcome of every event ``(key, seq, outcome, retries)``; an entry and its retries live ``ttl`` seconds."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    rows = events.select(key, seq, ts, event, F.unix_seconds(ts).cast("double").alias("second")).withWatermark(ts, delay)
    return rows.groupBy(key).transformWithStateInPandas(
        GuardProcessor((key, seq, event), ttl), f"{key} {kinds[key]}, {seq} {kinds[seq]}, outcome string, retries int", "Append", "EventTime")


def asks_with_outcomes(asks: DataFrame, outcomes: DataFrame, wait: str, delay: str = DELAY) -> DataFrame:
    """Every ask with each outcome of its key that came within ``wait``, or with none.

    ``asks (key, ask_id, asked_at)``, ``outcomes (key, outcome_id, outcome, done_at)``, both
    streams. An ask without an outcome comes when the watermark says that none can follow.
    """
    left = asks.withWatermark("asked_at", delay)
    right = outcomes.withColumnRenamed("key", "done_key").withWatermark("done_at", delay)
    within = F.expr(f"key = done_key AND done_at >= asked_at AND done_at <= asked_at + INTERVAL {wait}")
    return left.join(right, within, "leftOuter").select("key", "ask_id", "asked_at", "outcome_id", "outcome", "done_at")


def settled(joined: DataFrame) -> DataFrame:
    """``(ask_id, status, outcome_id)``: what the first outcome made of each ask.

    A success lets the question be asked again locally, a failure is shown, and an ask without
    an outcome stays pending.
    """
    first = joined.groupBy("ask_id").agg(F.min(F.when(F.col("outcome_id").isNotNull(), F.struct("done_at", "outcome_id", "outcome"))).alias("_first"))
    status = F.when(F.col("_first.outcome") == "succeeded", "retry_local").when(F.col("_first.outcome") == "failed", "ingest_failed").otherwise("pending")
    return first.select("ask_id", status.alias("status"), "_first.outcome_id")
