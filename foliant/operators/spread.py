"""Limits whose keys may hold any number of events: a key's events are dealt over many tasks.

Events are range-partitioned by key, time and id, so a hot key covers several partitions and each holds a stretch of its
time. What a stretch does to the state that reaches it is a function small enough to pass on:

* token bucket: with the time at which the bucket would be full again as state, a stretch of n events either resets the
  state (if it lies under a bound) or maps it to min(state + n T, cap), the cap rounded down to the state's own lattice.
  Two such functions follow each other as a list; a certain reset makes the list one constant.
* windows and lockout: a window's start alone decides where the next one starts. A stretch tells for each time at which
  a window may begin in it what is left open at its end; equal outcomes are held once.

A first pass makes one such function per partition. Functions of neighbouring stretches follow each other as one function
that is no larger than a single one may be, so tasks join the functions of a run of partitions (about the root of their number),
one task goes over the runs' functions, and tasks go over each run's own from its known start. A second pass decides every
event from its stretch's known start. Only the first key of a partition can have begun in an earlier one. No task holds more than
a partition's rows or a run's functions; the driver gets a state per partition and no function.

Times count in milliseconds. Rows without key or time are left out; events of the same time go by their id.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.runtime import checkpointed
from foliant.streaming.limits import Events

SCHEMA = "key string, at long, id long, label string, allowed boolean, retry_after long"
FUNCTIONS = "part int, first string, last string, data binary"
REACHED = "part int, first string, state binary"


@dataclass(frozen=True)
class TokenBucket:
    """`capacity` tokens, one more every `period` ms; an event costs one. State: when the bucket would be full again."""

    capacity: int = 30
    period: int = 500

    def step(self, full: int | None, now: int, _: str = "") -> tuple[int, bool, int]:
        late = (full if full is not None and full > now else now) - now - (self.capacity - 1) * self.period
        if late > 0:
            return full, False, -(-late // 1000)
        return max(now, full if full is not None else now) + self.period, True, 0

    def ends(self, full: int) -> int:
        """When a state is as good as none."""
        return full

    def function(self) -> BucketFunction:
        return BucketFunction(self.capacity, self.period)


@dataclass
class BucketFunction:
    """Pieces [n, bound, constant, cap]: a state under the bound goes to the constant, any other to min(state + n period, cap)."""

    capacity: int
    period: int
    pieces: list[list] = field(default_factory=list)

    def take(self, times: list[int]) -> None:
        rule = TokenBucket(self.capacity, self.period)
        for now in times:
            last = self.pieces[-1] if self.pieces else None
            if last and last[3] is not None and last[3] < now:  # whatever came before, the bucket is full
                self.pieces = [[0, None, now + self.period, None]]
                continue
            if last and last[3] is None:
                last[2] = rule.step(last[2], now)[0]
                continue
            if last is None or last[3] - self.period < now:  # perhaps full: a new piece, as the cap's lattice decides
                last = [0, now, None, None]
                self.pieces.append(last)
            n, bound, constant, cap = last
            if constant is None or now - n * self.period > bound:
                last[1], last[2] = max(bound, now - n * self.period), now + self.period
            else:
                last[2] = rule.step(constant, now)[0]
            top = now + self.capacity * self.period
            last[3] = top if cap is None else min(cap + self.period, top)
            last[0] = n + 1

    def then(self, after: BucketFunction) -> BucketFunction:
        """This stretch's function followed by that of the next one."""
        if not after.pieces or (len(after.pieces) == 1 and after.pieces[0][3] is None):
            return after if after.pieces else self
        if len(self.pieces) == 1 and self.pieces[0][3] is None:
            return BucketFunction(self.capacity, self.period, [[0, None, after(self.pieces[0][2]), None]])
        return BucketFunction(self.capacity, self.period, self.pieces + after.pieces)

    def __call__(self, full: int | None) -> int | None:
        for n, bound, constant, cap in self.pieces:
            if cap is None or full is None or full < bound:
                full = constant
            else:
                full = min(full + n * self.period, cap - (cap - full) % self.period)
        return full


@dataclass(frozen=True)
class Windows:
    """At most `most` events in a window of `length` ms, which opens with the first event after the last one's end. With
    `locked`, the event beyond locks the key for so long; else the window's other events are refused. State: (start,
    events so far, end of the lock or None)."""

    most: int = 50
    length: int = 60_000
    locked: int | None = None

    def step(self, state: tuple | None, now: int, _: str = "") -> tuple[tuple, bool, int]:
        if state and state[2] is not None and now < state[2]:
            return state, False, -(-(state[2] - now) // 1000)
        start, used, _ = state if state and state[2] is None and now - state[0] <= self.length else (now, 0, None)
        if used < self.most:
            return (start, used + 1, None), True, 0
        until = now + self.locked if self.locked else None
        return (start, used + 1, until), False, -(-((until or start + self.length) - now) // 1000)

    def ends(self, state: tuple) -> int:
        """When a state is as good as none."""
        return state[2] if state[2] is not None else state[0] + self.length + 1

    def function(self) -> WindowFunction:
        return WindowFunction(self)


@dataclass
class WindowFunction:
    """A stretch's first times, and for each time at which a window may open in it, what is left at its end."""

    rule: Windows
    times: list[np.ndarray] = field(default_factory=list)

    def take(self, times: list[int]) -> None:
        self.times.append(np.asarray(times, dtype=np.int64))

    def closed(self) -> WindowFunction:
        """The same without its times: the i-th outcome holds if the window opens with the first event from a time on that
        is at most upto[i]."""
        rule, t = self.rule, np.concatenate(self.times)
        starts, first = np.unique(t, return_index=True)
        ends = np.searchsorted(t, starts + rule.length, side="right")
        over = (ends - first > rule.most) if rule.locked else np.zeros(len(starts), dtype=bool)
        until = np.where(over, t[np.minimum(first + rule.most, len(t) - 1)] + (rule.locked or 0), 0)
        after = np.where(over, np.searchsorted(starts, until), np.searchsorted(starts, starts + rule.length, side="right"))
        stays = after >= len(starts)  # its window, or its lock, is the one left at the end
        final = np.where(stays, np.arange(len(starts)), after)
        while not stays[final].all():
            final = final[final]
        reach = int(np.searchsorted(starts, t[0] + rule.length + (rule.locked or 0) + 1)) + 1
        final = final[:reach]
        shown = np.append(np.flatnonzero(np.diff(final)), len(final) - 1)
        self.upto = starts[shown].tolist()
        self.left = [(int(starts[k]), rule.most, int(until[k])) if over[k] else (int(starts[k]), min(rule.most, len(t) - int(first[k])), None) for k in final[shown].tolist()]
        self.head, self.count, self.last = t[: rule.most + 1].tolist(), len(t), int(t[-1])
        self.times = []
        return self

    def then(self, after: WindowFunction) -> WindowFunction:
        """This stretch's function followed by that of the next one, as the function of both stretches as one."""
        both = WindowFunction(self.rule)
        both.head, both.count, both.last = (self.head + after.head)[: self.rule.most + 1], self.count + after.count, after.last
        reach = self.head[0] + self.rule.length + (self.rule.locked or 0) + 1  # the latest that a window can open from an earlier start
        upto, left = list(self.upto), [after(state) for state in self.left]
        if upto[-1] >= self.last:
            most = bisect_left(after.upto, reach) + 1
            upto, left = upto + after.upto[:most], left + after.left[:most]
        ends = [i for i in range(len(left)) if i + 1 == len(left) or left[i] != left[i + 1]]
        both.upto, both.left = [upto[i] for i in ends], [left[i] for i in ends]
        return both

    def __call__(self, state: tuple | None) -> tuple:
        opens = self.head[0]
        if state and state[2] is not None:
            if self.last < state[2]:
                return state
            opens = state[2]
        elif state and self.head[0] <= state[0] + self.rule.length:
            start, used, _ = state
            if self.rule.locked and used + bisect_right(self.head, start + self.rule.length) > self.rule.most:
                opens = self.head[self.rule.most - used] + self.rule.locked
                if self.last < opens:
                    return start, self.rule.most, opens
            else:
                opens = start + self.rule.length + 1
                if self.last < opens:
                    return start, min(self.rule.most, used + self.count), None
        return self.left[bisect_left(self.upto, opens)]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
    """Stretches of the same key, batch by batch."""
    for b in batches:
        for key, run in b.groupby("key", sort=False):
            yield key, run


def _after(key: str | None, state: tuple | int | None, r) -> tuple[str, tuple | int | None]:
    """The last key of a stretch and its state, if the stretch before ended with `key` and `state`."""
    function, end = pickle.loads(r.data)
    return (r.first, function(state if r.first == key else None)) if function is not None else (r.last, end)


def _joined(rows: pd.DataFrame) -> tuple[str, str | None, tuple]:
    """The stretches of a run as one: (first key, last key or None for one key, (function, end))."""
    rows = rows.sort_values("part")
    first, whole, key, end = rows["first"].iloc[0], None, None, None
    for i, r in enumerate(rows.itertuples(index=False)):
        if i == 0 or (whole is not None and r.first == first):
            function, end = pickle.loads(r.data)
            whole = function if i == 0 else whole.then(function) if function is not None else None
            key = r.last
        else:
            if whole is not None:  # the first key ends here
                key, whole = first, None
            key, end = _after(key, end if key == r.first else None, r)
    return first, key if whole is None else None, (whole, end if whole is None else None)


def _starts(functions: DataFrame, parts: int) -> dict[int, tuple | int | None]:
    """The state that reaches each partition whose first key began in an earlier one."""
    size = max(1, round(parts**0.5))
    functions = functions.withColumn("run", F.floor(F.col("part") / size).cast("int"))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        first, last, data = _joined(rows)
        return pd.DataFrame([{"part": int(rows["part"].min()) // size, "first": first, "last": last, "data": pickle.dumps(data)}])

    def follow(rows, key, state):
        found = []
        for r in rows.sort_values("part").itertuples(index=False):
            found.append((r.part, r.first, pickle.dumps((key, state))))
            key, state = _after(key, state, r)
        return pd.DataFrame(found, columns=["part", "first", "state"])

    def over(rows: pd.DataFrame) -> pd.DataFrame:
        return follow(rows, None, None)

    runs = functions.groupBy("run").applyInPandas(join, FUNCTIONS)
    before = {r.part: pickle.loads(r.state) for r in runs.withColumn("run", F.lit(0)).groupBy("run").applyInPandas(over, REACHED).collect()}

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        return follow(rows, *before[int(rows["part"].min()) // size])

    reached = [(r.part, r.first, *pickle.loads(r.state)) for r in functions.groupBy("run").applyInPandas(within, REACHED).collect()]
    return {part: state for part, first, key, state in reached if key == first}


def decide(df: DataFrame, events: Events, rule: TokenBucket | Windows) -> DataFrame:
    """Every event with (allowed, retry_after in seconds), as if the events of its key had been taken one by one."""
    at = F.unix_millis(F.col(events.time).cast("timestamp"))
    rows = df.select(F.col(events.key).cast("string").alias("key"), at.alias("at"), F.col(events.id).cast("long").alias("id"), F.col(events.label).cast("string").alias("label"))
    order = ("key", "at", "id", "label")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.where("key IS NOT NULL AND at IS NOT NULL").repartitionByRange(parts, *order).sortWithinPartitions(*order))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, function, key, state = None, None, None, None
        for k, run in _runs(batches):
            times = run["at"].tolist()
            if first is None:
                first, function = k, rule.function()
            if k == first:
                function.take(times)
                continue
            state = state if k == key else None
            key = k
            for now in times:
                state = rule.step(state, now)[0]
        if first is not None:
            function = function.closed() if isinstance(function, WindowFunction) else function
            made = (function, None) if key is None else (None, state)  # a stretch with a later key ends the same whatever came before
            yield pd.DataFrame([{"part": TaskContext.get().partitionId(), "first": first, "last": key, "data": pickle.dumps(made)}])

    functions = checkpointed(dealt.mapInPandas(summarise, FUNCTIONS))
    starts = _starts(functions, parts)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, begun = None, starts.get(TaskContext.get().partitionId()), False
        for k, run in _runs(batches):
            if k != key:
                key, state, begun = k, None if begun else state, True
            out = []
            for now in run["at"].tolist():
                state, *result = rule.step(state, now)
                out.append(result)
            yield run.assign(allowed=[r[0] for r in out], retry_after=[r[1] for r in out])

    return dealt.mapInPandas(take, SCHEMA)
