"""Table operators against small tables and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import catalogue as C
from foliant.operators import crawl, export, mutate, queue
from foliant.streaming import limits, logs


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_paging_clamps():
    assert (C.Page.of(-1, 9999).number, C.Page.of(-1, 9999).size, C.Page.of("x", None).size, C.Page.of(5, 12).offset) == (1, 100, 20, 48)
    assert C.page_strip(5, 10) == [1, None, 4, 5, 6, None, 10] and C.page_strip(2, 4) == [1, 2, 3, 4]


def test_lookup_raises_without_a_row(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert C.find_one_or_raise(df, id=1).collect()[0]["name"] == "a"
    with pytest.raises(Exception, match="no row"):
        C.find_one_or_raise(df, id=2).collect()


def test_children_and_empty_parents(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    kids = spark.createDataFrame([(1, 10), (1, 11)], "pid long, n long")
    assert rows(C.with_child_count(parents, kids, "id", "pid"), "id", "n_children") == [(1, 2), (2, 0)]
    assert rows(C.next_order(kids, parents, "id", "pid", "n"), "id", "next_order") == [(1, 12), (2, 1)]
    assert C.all_of(parents.where("id > 9"), F.lit(True)).collect()[0][:] == (False, False)
    tags = C.with_tags(parents, kids, spark.createDataFrame([(10, "b"), (11, "a")], "n long, tag string"), "id", "pid", "n", "n", "tag")
    assert rows(tags, "id", "tags") == [(1, ["a", "b"]), (2, [])]


def test_merge_keeps_absent_apart_from_null(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, n string, m string")
    patch = spark.createDataFrame([(1, None, True, "z", False)], "id long, n string, has_n boolean, m string, has_m boolean")
    assert sorted(tuple(r) for r in mutate.merge_update(base, patch, "id").select("id", F.coalesce("n", F.lit("-")), "m").collect()) == [(1, "-", "x"), (2, "b", "y")]


def test_transition_matrix(spark):
    states = ("pending", "running", "completed", "failed", "cancelled")
    pairs = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    ok = {(r["a"], r["b"]) for r in pairs.where(mutate.allowed(F.col("a"), F.col("b"))).collect()}
    assert ok == set(mutate.TRANSITIONS)


def test_task_times_are_set_once(spark):
    tasks = spark.createDataFrame([(1, "pending", None, None), (2, "running", "t0", None), (3, "completed", "t0", "t1")], "id long, status string, started_at string, completed_at string")
    moves = spark.createDataFrame([(1, "running"), (2, "failed"), (3, "running")], "id long, new_status string")
    got = mutate.move_state(tasks, moves, "id", F.lit("now")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "running", "now", None), (2, "failed", "t0", "now"), (3, "completed", "t0", "t1")]


QUEUE = "id long, task_id string, url string, status string, retries int, max_retries int, created_at int, updated_at int"


def test_queue(spark):
    q = spark.createDataFrame([(1, "t", "u", "pending", 0, 3, 1, 1), (2, "t", "v", "failed", 3, 3, 2, 2)], QUEUE)
    new = spark.createDataFrame([(3, "t", "u", "pending", 0, 3, 3, 3), (4, "t", "v", "pending", 0, 3, 4, 4), (5, "t", "v", "pending", 0, 3, 5, 5)], QUEUE)
    grown, ids = queue.enqueue(q, new, F.col("id"))
    assert rows(ids, "url", "id", "added") == [("u", 1, False), ("v", 4, True)] and grown.count() == 3
    after, taken = queue.take_batch(grown, F.lit(9), "t", 1)
    assert [r["id"] for r in taken.collect()] == [1] and rows(after, "id", "status")[0] == (1, "in_progress")
    settled = queue.settle(after, spark.createDataFrame([(1, False)], "id long, ok boolean"), F.lit(10))
    assert rows(settled, "id", "status", "retries")[0] == (1, "pending", 1)


def test_dedupe_both_equals_the_sequential_fold(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["", *"abcdefgh"]), rng.choice(["", *"pqrstuvw"])) for i in range(60)]
    kept, seen_u, seen_t = [], set(), set()
    for i, u, t in data:
        if (u and u in seen_u) or (t and t in seen_t):
            continue
        kept.append(i)
        seen_u.add(u)
        seen_t.add(t)
    df = spark.createDataFrame(data, "at long, url string, title string")
    assert [r["at"] for r in crawl.dedupe_books(df, "both", "at").orderBy("at").collect()] == kept
    assert crawl.dedupe_books(df.limit(0), "both", "at").count() == 0


def test_dedupe_both_of_a_long_chain(spark):
    """Each row shares its title with the next one's address group: only every other one stays; the jobs don't grow with the chain."""
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("at"), F.ceil(F.col("id") / 2).cast("string").alias("url"), F.floor(F.col("id") / 2).cast("string").alias("title"))
    hot = spark.range(n, n + 3000).select(F.col("id").alias("at"), F.lit("hot").alias("url"), F.concat(F.lit("t"), "id").alias("title"))
    spark.sparkContext.setJobGroup("chain", "chain")
    kept = [r["at"] for r in crawl.dedupe_books(chain.union(hot), "both", "at").orderBy("at").collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == [*range(0, n, 2), n]
    assert jobs < 400


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000 + (i * 7) % 50) for i in range(50)] + [(5, 5), (-9, -9), (2000, 2001)]
    got = {r["node"]: r["root"] for r in crawl.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {x: find(x) for x in root}


def test_pages_stop_at_loops(spark):
    pages = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", None)], "url string, next_url string")
    starts = spark.createDataFrame([("a",), ("x",)], "url string")
    assert rows(crawl.follow_pages(starts, pages, 10), "start", "url", "page_no") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("x", "x", 0)]
    assert crawl.follow_pages(starts, pages).count() == 2


def test_every_row_of_an_address_is_matched(spark):
    stored = spark.createDataFrame([(1, "u", "x", 1), (2, "u", "y", 3), (3, "v", "t", 2), (4, "", "z", 9)], "id long, url string, title string, updated_at int")
    new = spark.createDataFrame([(1, "u", "t"), (2, "u", "no"), (3, "", "no"), (4, "no", "t")], "k long, url string, title string")
    got = sorted((r["k"], r["match"] or 0) for r in crawl.match_books(new, stored, every=True).collect())
    assert got == [(1, 2), (1, 3), (2, 1), (2, 2), (3, 0), (4, 3)]


def test_matches_prefer_the_latest(spark):
    stored = spark.createDataFrame([(1, "u", "t", 5), (2, "u2", "t", 9)], "id long, url string, title string, updated_at int")
    new = spark.createDataFrame([(1, "u", "t"), (2, "u", "no"), (3, "", ""), (4, "no", "t")], "k long, url string, title string")
    assert [r["match"] for r in crawl.match_books(new, stored).orderBy("k").collect()] == [2, 1, None, 2]


@pytest.mark.parametrize(("content", "place", "want"), [
    ("a\n\nb\nc", "middle", "T\n\na\n\n\nAD T\n\nb\n\nc\n\n"), ("", "middle", "T\n\n"), (None, "end", "T\n\n\nAD T\n\n"), ("a", "start", "\nAD T\n\nT\n\na\n\n"),
])
def test_export_places_adverts(spark, content, place, want):
    books = spark.createDataFrame([(1, "B", "A")], "k long, title string, author string")
    chapters = spark.createDataFrame([(1, 1, 1, "T", content)], "k long, sort_order int, id int, title string, content string")
    got = export.export_text(books, chapters, "k", export.ExportConfig(ad="AD {chapterTitle}", ad_every=1, ad_at=place), F.current_date()).collect()[0]
    assert got["text"] == want and got["file_name"] == "B - A.txt" and got["n_bytes"] == len(want.encode())


def fold(step, events):
    state, out = None, []
    for at, label in events:
        state, result = step(state, at, label)
        out.append(result[0])
    return out


def test_limit_steps():
    assert fold(limits.fixed_windows(((2, 60.0),)), [(0, ""), (1, ""), (2, ""), (60, ""), (60.5, ""), (119, ""), (119.5, "")]) == [True, True, False, False, True, True, False]
    assert fold(limits.token_bucket(2, 1), [(0, ""), (0, ""), (0, ""), (1, ""), (1.5, "")]) == [True, True, False, True, False]
    assert fold(limits.circuit_breaker(2, 30), [(0, "error"), (1, "error"), (2, "ok"), (31, "error"), (40, "ok"), (61, "ok"), (62, "ok")]) == [True, True, False, True, False, True, True]
    assert fold(limits.throttle(3, ("status",)), [(0, ""), (1, ""), (2, "status"), (4, ""), (5, "")]) == [True, False, True, False, True]
    assert fold(limits.lockout(2, 60, 300), [(0, ""), (1, ""), (2, ""), (100, ""), (303, "")]) == [True, True, False, False, True]


def test_batch_and_stream_agree(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    names = limits.Events("user_id", "ts", "event_id", "event_type")
    step = limits.fixed_windows(((3, 3600.0 * 24),))
    batch = limits.run_batch(events, names, step)
    want = rows(batch, "id", "allowed")
    by_user: dict = {}
    for r in events.orderBy("ts", "event_id").collect():
        by_user.setdefault(r["user_id"], []).append((r["ts"].timestamp(), r["event_type"], r["event_id"]))
    brute = sorted((i, ok) for es in by_user.values() for (_, _, i), ok in zip(es, fold(step, [(a, b) for a, b, _ in es]), strict=True))
    assert want == brute
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = limits.run_stream(stream, names, step).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert rows(spark.table("limited"), "id", "allowed") == want


def test_log_sink(spark, tmp_path):
    spark.createDataFrame([("m" * 600, "d", None)], "message string, detail string, level string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("message string, detail string, level string").parquet(str(tmp_path / "in"))
    logs.start_log_sink(stream, str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()[0]
    assert len(got["message"]) == 503 and got["level"] == "info"
