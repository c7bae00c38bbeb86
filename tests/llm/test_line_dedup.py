from __future__ import annotations

import random
from collections import defaultdict

import pytest

from foliant.llm import line_dedup as x

from .cases import documents

BLANKS = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [v for v in lines if i is None or len(key(v)) < 10 or i == min(holders[key(v)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def made():
    rng = random.Random(5)
    pool = [f"This line number {i} is shared." for i in range(30)] + ["short", "", "ÄÖÜ äöü ÄÖÜ", "äöü äöü äöü", "  padded shared line\t", "PADDED SHARED LINE"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(1, 80)]
    rows += [(200 + i, "one line that a third of all rows hold\nown line of row %d" % i) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, "\n".join(f"a very long text, line {k % 700}" for k in range(5000))), (None, pool[0]), (7, rows[6][1]), (7, pool[1] + "\nanother text of row 7")]


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_against_brute_force(spark, batches):
    rows = made()
    got = x.dedup_lines(documents(spark, rows), batches=batches).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def keyed(spark, keys, doc=1):
    return spark.createDataFrame([(bytes(k), doc) for k in keys], "key binary, doc_id long")


def filled(spark, batches=5, **named):
    store = x.RunStore(spark, **named)
    for n in range(batches):
        store.add(keyed(spark, [[n, k] for k in range(3)] + [[0, 0]]))
        store.compact()
    return store


@pytest.mark.parametrize("buckets", [None, 2])
def test_compaction_keeps_few_runs(spark, buckets):
    store = filled(spark, buckets=buckets)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    marked = store.mark(keyed(spark, [[4, 1], [9, 9]])).collect()
    assert {bytes(r["key"]): r["old"] for r in marked} == {bytes([4, 1]): True, bytes([9, 9]): False}
    assert sum(r.count() for r in store.runs()) == 15
    store.drop()


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_runs_are_merged_without_shuffle_or_sort(spark):
    """The only Exchange is that of the batch's own keys, the only Sort is above it; compaction has neither."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    store = filled(spark, 3)
    names = [n for level in store.levels for n in level]
    assert len(names) == 2
    merged = plan(store.merged(names))
    assert "SortMergeJoin" in merged and "Exchange" not in merged and "Sort " not in merged
    marked = plan(store.mark(keyed(spark, [[1, 1]]).groupBy("key").count()))
    assert marked.count("SortMergeJoin") == 2 and marked.count("Exchange") == 1 and marked.count("Sort ") == 1
    store.drop()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_go_when_a_batch_fails(spark, monkeypatch):
    monkeypatch.setattr(x, "line_key", lambda c: x.F.raise_error(x.F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        x.dedup_lines(documents(spark, [(1, "some text of a document")]))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_empty(spark):
    assert x.dedup_lines(documents(spark, [])).count() == 0
