"""Streams with state that ends, and the log sink, over several runs of each query."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from foliant.operators import spread
from foliant.streaming import expiring, logs
from foliant.streaming.limits import Events

NAMES = Events("k", "ts", "id", "label")
ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)
BASE = int(ZERO.timestamp() * 1000)
KINDS = "k string, ts timestamp, id long, label string"


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set(*expiring.STATE_STORE)
    yield
    spark.conf.unset(expiring.STATE_STORE[0])


def run(spark, tmp_path, batches, build):
    """The stream's rows after every batch was given to a newly started query, and the state rows left at the end."""
    folder, left = tmp_path / "in", None
    for n, batch in enumerate(batches):
        rows = [(k, ZERO + timedelta(milliseconds=at), i, label) for k, at, i, label in batch]
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(KINDS).parquet(str(folder))
        q = build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert n or max(states) > 0
        left = states[-1] if states else left
    return spark.read.parquet(str(tmp_path / "out")).collect(), left


@pytest.mark.parametrize("rule", (spread.TokenBucket(2, 700), spread.Windows(2, 3000, 9000), expiring.Throttle(3000, ("done",))), ids=str)
def test_limits_over_restarts(spark, tmp_path, rule):
    rng, events = random.Random(2), []
    for i in range(240):
        events.append((f"k{rng.randint(0, 5)}", i * 150 + rng.randint(0, 100), i, rng.choice(("x", "done"))))
    end = [("end", 10_000_000, 999, "x")]
    got, left = run(spark, tmp_path, [events[:100], events[100:101], events[101:], end], lambda s: expiring.limit_stream(s, NAMES, rule))
    states, want = {}, {}
    for k, at, i, label in [*sorted(events, key=lambda e: (e[1], e[2])), *end]:
        states[k], *result = rule.step(states.get(k), BASE + at, label)
        want[i] = tuple(result)
    assert {r["id"]: (r["allowed"], r["retry_after"]) for r in got} == want and len(got) == len(want)
    assert left <= 2  # the last key's value and timer


def test_breaker_opens_half_opens_and_closes(spark, tmp_path):
    a = [("a", 0, 1, "error"), ("a", 1000, 2, "error"), ("a", 2000, 3, "error"), ("a", 3000, 4, "ok"), ("b", 0, 5, "error"), ("b", 10, 6, "ok"), ("c", 0, 7, "error"), ("c", 1, 8, "error"), ("c", 2, 9, "error")]
    b = [("d", 100_000, 10, "ok")]
    c = [("a", 101_000, 11, "error"), ("a", 102_000, 12, "ok"), ("c", 103_000, 13, "ok")]
    d = [("d", 200_000, 14, "ok")]
    e = [("a", 201_000, 15, "ok")]
    got, left = run(spark, tmp_path, [a, b, c, d, e], lambda s: expiring.breaker_stream(s, NAMES))
    assert sorted((r["key"], r["at"] - BASE, r["state"]) for r in got) == [
        ("a", 2000, "open"), ("a", 32_000, "half-open"), ("a", 101_000, "open"), ("a", 131_000, "half-open"), ("a", 201_000, "closed"),
        ("c", 2, "open"), ("c", 30_002, "half-open"), ("c", 103_000, "closed"),
    ]
    assert left == 0


def test_tasks_time_out(spark, tmp_path):
    h = 3_600_000
    a = [("t1", 0, 1, "started"), ("t2", 5, 2, "started"), ("t3", 10, 3, "started"), ("t1", 100, 4, "progress"), ("t3", 20, 5, "failed"), ("t4", 7, 6, "progress"), ("t5", 0, 13, "started")]
    b = [("t1", h - 1, 7, "completed"), ("t3", h, 8, "started"), ("t5", h + 1, 14, "completed")]
    c = [("t9", 3 * h, 9, "progress")]
    got, left = run(spark, tmp_path, [a, b, c, [("t9", 4 * h, 10, "progress")]], lambda s: expiring.task_outcomes(s, NAMES))
    assert sorted((r["key"], r["started"] - BASE, r["at"] - BASE, r["outcome"]) for r in got) == [
        ("t1", 0, h - 1, "completed"), ("t2", 5, 5 + h, "timeout"), ("t3", 10, 20, "failed"), ("t3", h, 2 * h, "timeout"), ("t5", 0, h, "timeout"),
    ]
    assert left == 0


def flushed(rows, most, kept=10, flush=50):
    tasks: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        tasks.setdefault(r[0], []).append(r)
    out = [(r[2], n // flush) for rs in tasks.values() for n, r in enumerate(rs[: len(rs) - len(rs) % flush])]
    waiting = {t: rs[len(rs) - len(rs) % flush :] for t, rs in tasks.items() if len(rs) % flush}
    total = sum(map(len, waiting.values()))
    for t in sorted(waiting, key=lambda t: (waiting[t][0][1], waiting[t][0][2])):
        cut = max(0, len(waiting[t]) - kept) if total > most else 0
        total -= cut
        out += [(r[2], len(tasks[t]) // flush) for r in waiting[t][cut:]]
    return sorted(out)


@pytest.mark.parametrize("most", (1000, 30, 0))
def test_flushes(spark, most):
    rng = random.Random(most)
    rows = [(f"t{min(rng.randint(0, 9), rng.randint(0, 9))}", rng.randint(0, 300), i) for i in range(700)] + [("hot", 5, 1000 + i) for i in range(650)]
    df = spark.createDataFrame(rows, "task_id string, created_at long, id long").repartition(4)
    assert sorted((r["id"], r["flush"]) for r in logs.flushes(df, most=most).collect()) == flushed(rows, most)


def test_a_failed_batch_is_written_once(spark, tmp_path):
    schema = "id long, task_id string, created_at long, level string, message string, detail string"
    rows = [(i, f"t{i % 3}", i, None, "m" * 700, None) for i in range(120)]
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame(rows[:80], schema).write.parquet(folder)

    def crash(n):
        raise RuntimeError("lost after the write")

    start = lambda after=None: logs.start_log_sink(spark.readStream.schema(schema).parquet(folder), out, check, once=True, after=after)
    with pytest.raises(Exception, match="lost after the write"):
        start(crash).awaitTermination()
    assert spark.read.parquet(out).count() == 80
    start().awaitTermination()
    assert spark.read.parquet(out).count() == 80
    spark.createDataFrame(rows[80:], schema).write.mode("append").parquet(folder)
    start().awaitTermination()
    got = spark.read.parquet(out).select("id", "level", F.length("message").alias("n")).collect()
    assert sorted(r["id"] for r in got) == list(range(120)) and {(r["level"], r["n"]) for r in got} == {("info", 503)}
