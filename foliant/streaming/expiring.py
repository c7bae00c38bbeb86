"""Keyed state that ends: limits whose state goes when it no longer counts, a breaker's half-open timer, task timeouts.

Each runs as a stateful stream processor over event time. A timer stands at the moment when a key's state is as good as
none; once the watermark has passed it, the state is removed, so the store holds only keys with something at stake. Events
of a key are taken in the order of time and id within a micro-batch; those later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliant.operators.spread import SCHEMA
from foliant.streaming.limits import Events

#: What a session needs for these processors.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Throttle:
    """At most one event in `length` ms, but for those with a label that always goes. State: the last one sent."""

    length: int = 3000
    always: tuple[str, ...] = ()

    def step(self, last: int | None, now: int, label: str = "") -> tuple[int, bool, int]:
        if last is None or label in self.always or now - last >= self.length:
            return now, True, 0
        return last, False, -(-(last + self.length - now) // 1000)

    def ends(self, last: int) -> int:
        return last + self.length


def _timed(df: DataFrame, e: Events, late: str) -> DataFrame:
    rows = df.select(F.col(e.key).cast("string").alias("key"), F.col(e.time).cast("timestamp").alias("ts"), F.col(e.id).cast("long").alias("id"), F.col(e.label).cast("string").alias("label"))
    return rows.where("key IS NOT NULL AND ts IS NOT NULL").withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)


class _Keyed(StatefulProcessor):
    """One JSON value and at most one timer per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string")

    def load(self):
        value = json.loads(self.held.get()[0]) if self.held.exists() else None
        return tuple(value) if isinstance(value, list) else value

    def store(self, state, timer: int | None) -> None:
        """timer: when to look at the key again; without a state there is neither."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state is None:
            self.held.clear()
            return
        self.held.update((json.dumps(state),))
        if timer is not None:
            self.handle.registerTimer(timer)

    def close(self) -> None:
        pass


class _Limit(_Keyed):
    def __init__(self, rule) -> None:
        self.rule = rule

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, events = self.load(), pd.concat(list(rows)).sort_values(["at", "id"])
        out = []
        for now, label in zip(events["at"].tolist(), events["label"], strict=True):
            state, *result = self.rule.step(state, now, label)
            out.append(result)
        self.store(state, self.rule.ends(state))
        yield events.drop(columns="ts").assign(allowed=[r[0] for r in out], retry_after=[r[1] for r in out])[["key", "at", "id", "label", "allowed", "retry_after"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.store(None, None)
        return iter(())


def limit_stream(df: DataFrame, events: Events, rule, late: str = "10 seconds") -> DataFrame:
    """Every event of a stream with (allowed, retry_after in seconds) under a TokenBucket, Windows or Throttle rule."""
    return _timed(df, events, late).groupBy("key").transformWithStateInPandas(_Limit(rule), SCHEMA, "Append", "EventTime")


class _Breaker(_Keyed):
    """State: (failures, opened at or None, half-open)."""

    def __init__(self, failures: int, rest: int, bad: tuple[str, ...]) -> None:
        self.failures, self.rest, self.bad = failures, rest, bad

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failed, opened, half = self.load() or (0, None, False)
        said = []
        events = pd.concat(list(rows)).sort_values(["at", "id"])
        for now, label in zip(events["at"].tolist(), events["label"], strict=True):
            if opened is not None and now - opened < self.rest:
                continue  # refused
            if opened is not None and not half:
                half = True
                said.append((key[0], opened + self.rest, "half-open"))
            if label in self.bad:
                failed += 1
                if failed >= self.failures:
                    opened, half = now, False
                    said.append((key[0], now, "open"))
            else:
                if opened is not None:
                    said.append((key[0], now, "closed"))
                failed, opened, half = 0, None, False
        self.store((failed, opened, half) if failed else None, opened + self.rest if opened is not None and not half else None)
        yield pd.DataFrame(said, columns=["key", "at", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failed, opened, _ = self.load()
        self.store((failed, opened, True), None)
        yield pd.DataFrame([(key[0], opened + self.rest, "half-open")], columns=["key", "at", "state"])


def breaker_stream(df: DataFrame, events: Events, failures: int = 3, rest: int = 30_000, bad: tuple[str, ...] = ("error",), late: str = "10 seconds") -> DataFrame:
    """(key, at, state): when each key's breaker opens, half-opens (by a timer, with no call needed) and closes. An event is
    a call and its outcome; those that come while it is open are refused and don't count, the first one after the rest is
    the probe. A closed breaker without failures has no state."""
    return _timed(df, events, late).groupBy("key").transformWithStateInPandas(_Breaker(failures, rest, bad), "key string, at long, state string", "Append", "EventTime")


class _Tasks(_Keyed):
    """State: the start."""

    def __init__(self, limit: int, ends: tuple[str, ...]) -> None:
        self.limit, self.ends = limit, ends

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, said = self.load(), []
        events = pd.concat(list(rows)).sort_values(["at", "id"])
        for now, label in zip(events["at"].tolist(), events["label"], strict=True):
            if started is not None and now > started + self.limit:
                said.append((key[0], started, started + self.limit, "timeout"))
                started = None
            if label in self.ends:
                if started is not None:
                    said.append((key[0], started, now, label))
                started = None
            elif started is None and label == "started":
                started = now
        self.store(started, started + self.limit if started is not None else None)
        yield pd.DataFrame(said, columns=["key", "started", "at", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started = self.load()
        self.store(None, None)
        yield pd.DataFrame([(key[0], started, started + self.limit, "timeout")], columns=["key", "started", "at", "outcome"])


def task_outcomes(df: DataFrame, events: Events, limit: int = 3_600_000, ends: tuple[str, ...] = ("completed", "failed", "cancelled"), late: str = "10 seconds") -> DataFrame:
    """(key, started, at, outcome) of every run of a task: how it ended, or `timeout` at its limit, which a timer tells though
    nothing more is heard of it."""
    return _timed(df, events, late).groupBy("key").transformWithStateInPandas(_Tasks(limit, ends), "key string, started long, at long, outcome string", "Append", "EventTime")
