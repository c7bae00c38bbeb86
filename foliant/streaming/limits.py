"""Order-dependent limits per key: windows that open at their first event, token buckets, breakers and throttles.

In batch, a key's events are streamed in order through a small state: rows are dealt by key and sorted within their
partition, so no key's events are held together in memory. The same steps run in Structured Streaming with keyed state.
A key's events depend on each other, so here one task takes them one by one, and keys run side by side;
`foliant.operators.spread` deals a hot key's events over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A step takes the state (None at first) and an event's time in seconds and label; it gives the new state and a result.
Step = Callable[[tuple | None, float, str], tuple[tuple, tuple]]


def fixed_windows(limits: tuple[tuple[int, float], ...]) -> Step:
    """(allowed, used): at most n events per window for each (n, seconds); a window opens with the first event after the
    last one ended, and refused events don't count."""

    def step(state: tuple | None, now: float, _: str) -> tuple[tuple, tuple]:
        state = state or tuple(0.0 for _ in range(2 * len(limits)))
        fresh = []
        for i, (_, seconds) in enumerate(limits):
            start, used = state[2 * i : 2 * i + 2]
            fresh.append((now, 0.0) if used == 0 or now - start > seconds else (start, used))
        ok = all(used < n for (_, used), (n, _) in zip(fresh, limits, strict=True))
        fresh = [(start, used + ok) for start, used in fresh]
        return tuple(float(x) for pair in fresh for x in pair), (ok, float(fresh[0][1]))

    return step


def token_bucket(capacity: float = 30.0, per_second: float = 2.0) -> Step:
    """(allowed, retry_after): a full bucket refills steadily; each event costs one token."""

    def step(state: tuple | None, now: float, _: str) -> tuple[tuple, tuple]:
        tokens, last = state or (capacity, now)
        tokens = min(capacity, tokens + (now - last) * per_second)
        if tokens >= 1:
            return (tokens - 1, now), (True, 0.0)
        return (tokens, now), (False, float(-((tokens - 1) // per_second)))

    return step


def lockout(most: int = 50, seconds: float = 60.0, locked: float = 300.0) -> Step:
    """(allowed, locked_until): more than `most` events within a window lock the key for a while."""

    def step(state: tuple | None, now: float, _: str) -> tuple[tuple, tuple]:
        start, used, until = state or (now, 0.0, 0.0)
        if now < until:
            return (start, used, until), (False, until)
        if now - start > seconds:
            start, used = now, 0.0
        used += 1
        if used > most:
            return (now, 0.0, now + locked), (False, now + locked)
        return (start, used, until), (True, until)

    return step


def circuit_breaker(failures: int = 3, rest: float = 30.0, bad: tuple[str, ...] = ("error",)) -> Step:
    """(allowed, failures): open after some failures in a row; after a rest, a single event probes whether to close."""

    def step(state: tuple | None, now: float, label: str) -> tuple[tuple, tuple]:
        failed, opened = state or (0.0, -1.0)
        if opened >= 0 and now - opened < rest:
            return (failed, opened), (False, failed)
        if label in bad:
            failed += 1
            opened = now if failed >= failures or opened >= 0 else -1.0
        else:
            failed, opened = 0.0, -1.0
        return (failed, opened), (True, failed)

    return step


def throttle(seconds: float = 3.0, always: tuple[str, ...] = ()) -> Step:
    """(sent, last): at most one event in a while, but for those with a label that always goes."""

    def step(state: tuple | None, now: float, label: str) -> tuple[tuple, tuple]:
        last = state[0] if state else None
        if last is None or label in always or now - last >= seconds:
            return (now,), (True, now)
        return (last,), (False, last)

    return step


@dataclass(frozen=True)
class Events:
    """The columns of an event table."""

    key: str
    time: str
    id: str
    label: str


def _prepared(df: DataFrame, e: Events) -> DataFrame:
    seconds = F.unix_micros(F.col(e.time).cast("timestamp")) / 1e6
    return df.select(F.col(e.key).cast("string").alias("key"), seconds.alias("at"), F.col(e.id).cast("long").alias("id"), F.col(e.label).cast("string").alias("label"))


SCHEMA = "key string, at double, id long, label string, allowed boolean, value double"


def run_batch(df: DataFrame, events: Events, step: Step) -> DataFrame:
    """Every event with (allowed, value), in the order of time and id within its key."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out = []
            for k, at, label in zip(b["key"], b["at"], b["label"], strict=True):
                if k != key:
                    key, state = k, None
                state, result = step(state, at, label)
                out.append(result)
            yield b.assign(allowed=[r[0] for r in out], value=[float(r[1]) for r in out])

    rows = _prepared(df, events).where("key IS NOT NULL AND at IS NOT NULL")
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(fold, SCHEMA)


def run_stream(df: DataFrame, events: Events, step: Step) -> DataFrame:
    """The same over a stream. A micro-batch's events of a key are put in order before they are taken; an event older than the last one taken counts at its own time."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(kept.get[0]) if kept.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out = []
        for at, label in zip(rows["at"], rows["label"], strict=True):
            state, result = step(state, at, label)
            out.append(result)
        if state is not None:
            kept.update((list(state),))
        yield rows.assign(allowed=[r[0] for r in out], value=[float(r[1]) for r in out])

    return _prepared(df, events).groupBy("key").applyInPandasWithState(fold, SCHEMA, "state array<double>", "append", GroupStateTimeout.NoTimeout)
