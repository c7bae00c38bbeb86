"""Limits over hot keys against the fold that takes a key's events one by one."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from foliant.operators import spread
from foliant.streaming.limits import Events, lockout, token_bucket

NAMES = Events("user", "ts", "id", "kind")
RULES = (
    spread.TokenBucket(3, 500), spread.TokenBucket(1, 7), spread.TokenBucket(30, 500), spread.TokenBucket(2, 1), spread.Windows(3, 100), spread.Windows(1, 1),
    spread.Windows(2, 50, 170), spread.Windows(5, 60, 20), spread.Windows(1, 10, 10), spread.Windows(50, 60_000, 300_000),
)


def stretch(rng, rule):
    """Times in bursts and pauses of the rule's own scale, with ties."""
    unit = getattr(rule, "period", None) or rule.length // 4 + 1
    now, out = 0, []
    for _ in range(rng.randint(1, 120)):
        now += rng.choice((0, 0, 1, unit // 3, unit - 1, unit, unit + 1, unit * rng.randint(0, 5), unit * 35 if rng.random() < 0.1 else 0))
        out.append(now)
    return out


@pytest.mark.parametrize("rule", RULES, ids=str)
def test_functions_of_stretches(rule):
    """Cut anywhere, the functions of the pieces give the state of the fold, however it is told."""
    rng = random.Random(str(rule))
    for _ in range(400):
        times = stretch(rng, rule)
        cuts = sorted(rng.randint(0, len(times)) for _ in range(rng.randint(0, 4)))
        state, at = None, 0
        for a, b in zip([0, *cuts], [*cuts, len(times)], strict=True):
            if a == b:
                continue
            f = rule.function()
            half = rng.randint(a, b)
            f.take(times[a:half])
            f.take(times[half:b])
            state = (f.closed() if isinstance(rule, spread.Windows) else f)(state)
            want = None
            for now in times[:b]:
                want = rule.step(want, now)[0]
            future = [times[b - 1] + d for d in (0, 0, 0, 1, 3, 40, 41, 400, 2000, 70_000, 400_000)]
            x, y = state, want
            for now in sorted(future):  # the same decisions from then on
                (x, *mine), (y, *theirs) = rule.step(x, now), rule.step(y, now)
                assert mine == theirs, (rule, times[:b], cuts)


@pytest.mark.parametrize("rule", RULES, ids=str)
def test_functions_follow_each_other_as_one(rule):
    rng = random.Random(f"then {rule}")
    for _ in range(400):
        times = [t + 10 * rule.length for t in stretch(rng, rule)] if isinstance(rule, spread.Windows) else stretch(rng, rule)
        cuts = sorted({0, len(times), *(rng.randint(0, len(times)) for _ in range(rng.randint(2, 6)))})
        whole = before = None
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if n == 0 and rng.random() < 0.7:  # some state reaches the first stretch
                for now in times[a:b]:
                    before = rule.step(before, now)[0]
                continue
            f = rule.function()
            f.take(times[a:b])
            f = f.closed() if isinstance(rule, spread.Windows) else f
            whole = f if whole is None else whole.then(f)
        if whole is None:
            continue
        x, y = whole(before), None
        for now in times:
            y = rule.step(y, now)[0]
        for now in sorted(times[-1] + d for d in (0, 0, 0, 1, 3, 40, 41, 400, 2000, 70_000, 400_000)):
            (x, *mine), (y, *theirs) = rule.step(x, now), rule.step(y, now)
            assert mine == theirs, (rule, times, cuts)


def test_steps_are_those_of_the_stream():
    rng = random.Random(4)
    for mine, theirs, unit in ((spread.TokenBucket(3, 500), token_bucket(3.0, 2.0), 250), (spread.Windows(2, 60_000, 300_000), lockout(2, 60.0, 300.0), 10_000)):
        a = b = None
        now = 0
        for _ in range(3000):
            now += unit * rng.choice((0, 0, 1, 2, 3, 9, 40))
            a, ok, _ = mine.step(a, now)
            b, (allowed, _) = theirs(b, now / 1000, "")
            assert ok == allowed


@pytest.mark.parametrize("rule", (spread.TokenBucket(3, 700), spread.Windows(4, 3000), spread.Windows(6, 3000, 9000)), ids=str)
def test_one_key_over_many_tasks(spark, rule, monkeypatch):
    """A key with nine tenths of the rows is dealt over partitions; every decision is the fold's."""
    rng, zero = random.Random(7), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(None if i % 97 == 0 else f"u{rng.randint(1, 40)}" if i % 10 == 0 else "hot", zero + timedelta(milliseconds=rng.randint(0, 900_000)), i, "x") for i in range(6000)]
    df = spark.createDataFrame(rows, "user string, ts timestamp, id long, kind string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        pulled, local = [], type(df).toLocalIterator
        monkeypatch.setattr(type(df), "toLocalIterator", lambda self, *a: pulled.append(self) or local(self, *a))
        got = spread.decide(df, NAMES, rule)
        largest = max(len(p) for p in got.rdd.glom().collect())
        found = {r["id"]: (r["allowed"], r["retry_after"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert largest < 1500
    assert not pulled, "functions of stretches stay off the driver"
    want, states = {}, {}
    for user, ts, i, _ in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1], r[2])):
        states[user], *result = rule.step(states.get(user), round((ts - zero).total_seconds() * 1000) + int(zero.timestamp() * 1000))
        want[i] = tuple(result)
    assert found == want


def test_no_events(spark):
    df = spark.createDataFrame([], "user string, ts timestamp, id long, kind string")
    assert spread.decide(df, NAMES, spread.TokenBucket()).count() == 0
