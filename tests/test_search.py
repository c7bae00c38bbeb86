from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import search


@pytest.fixture(scope="module")
def books(spark):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("abcé🙂 \n") for _ in range(rng.choice((0, 1, 2, 3, 9, 60))))
    rows = [(i, text(), rng.choice((None, text())), f"u{i}", rng.randint(0, 50)) for i in range(300)] + [(900, None, None, None, None), (901, "x" * 5000 + "needle", "", "u901", 1)]
    return rows, spark.createDataFrame(rows, "id long, title string, description string, url string, updated_at int")


def test_grams(spark):
    got = spark.sql("select explode(array('abcab', 'ab', '', null, 'é🙂\\nx')) as t").select(search.grams(F.col("t"))).collect()
    assert [r[0] for r in got] == [["abc", "bca", "cab"], ["ab"], [], [], ["é🙂\n", "🙂\nx"]]


def test_containing_against_brute_force(spark, books, tmp_path):
    rows, df = books
    rng = random.Random(3)
    needles = ["", None, "needle", "zzz", "ab", "a", "🙂", "\n", "abc"] + ["".join(rng.choice("abcé🙂 \n") for _ in range(rng.randint(1, 6))) for _ in range(80)] + ["needle"]
    columns = [F.col("title"), F.col("description")]
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    want = sorted({(n, i) for n in needles if n for i, t, s, *_ in rows if n in (t or "") or n in (s or "")})
    search.TrigramIndex.write(df, "id", *columns, folder=str(tmp_path))
    for index in (search.TrigramIndex.over(df, "id", *columns), search.TrigramIndex.read(spark, str(tmp_path))):
        found = search.containing(asked, index, df, "id", *columns)
        assert sorted((r["needle"], r["key"]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("most", [1, 3, 100])
def test_match_contained(spark, books, most):
    rows, df = books
    stored = df.withColumn("author", F.lit("an author"))
    new = [(k, url, title) for k, (url, title) in enumerate([(f"u{i % 40}", t) for i, t, *_ in rows[:60] if t] + [("u1", "a"), ("u2", "b"), ("none", "ab"), (None, "a"), ("u3", ""), ("u4", None), ("u5", "author")])]
    want = {}
    for k, url, title in new:
        held = [r for r in rows if title and (title in (r[1] or "") or title in (r[2] or "") or title in "an author")]
        held.sort(key=lambda r: (r[4] is None, -(r[4] or 0), -r[0]))
        want[k] = next((r[0] for r in held[:most] if (url and r[3] == url) or r[1] == title), None)
    got = search.match_contained(spark.createDataFrame(new, "k long, url string, title string"), stored, most=most).collect()
    assert {r["k"]: r["match"] for r in got} == want and len(got) == len(new)


def test_repeated_rows_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Files of repeated values are small, so Spark's estimate would send the rows to every task."""
    monkeypatch.setattr("foliant.runtime.BROADCAST_BYTES", 1000, raising=False)
    spark.range(20_000).select("id", F.lit("large ring").alias("name")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    asked = spark.createDataFrame([("arge",), ("none",), ("r",)], "needle string")
    found = search.containing(asked, search.TrigramIndex.over(rows, "id", F.col("name")), rows, "id", F.col("name"))
    assert found.count() == 40_000
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_grams_are_the_same_in_columns_and_in_tasks(spark):
    texts = ["abcab", "ab", "", None, "é🙂\nx", "a\x00\x00", "\x00", "🙂" * 5]
    column = spark.createDataFrame([(t,) for t in texts], "t string").select(F.transform(search.grams(F.col("t")), search.code)).collect()
    assert [sorted(r[0]) for r in column] == [search.gram_codes((t,)).tolist() for t in texts]


def test_an_index_of_the_session_writes_no_postings(spark, monkeypatch):
    """Nearly as many postings as characters: writing them took most of a lookup's time."""
    written = []
    monkeypatch.setattr(search, "checkpointed", lambda df: written.append(df.columns) or df)
    index = search.TrigramIndex.over(spark.createDataFrame([(1, "one two")], "id long, t string"), "id", F.col("t"))
    assert written == [["gram", "n"]] and index.postings.count() == 5


def test_a_frequent_second_trigram_is_not_looked_up(spark):
    """Its postings are read for every search text that has it, so their number grows with the square of the table."""
    rows = spark.range(50).select("id", F.concat(F.lit("common "), F.char(F.lit(65) + F.col("id").cast("int"))).alias("t"))
    index = search.TrigramIndex.over(rows, "id", F.col("t"))
    asked = rows.select(F.col("t").alias("needle"))
    assert {(r["needle"], r["key"]) for r in search.containing(asked, index, rows, "id", F.col("t")).collect()} == {(r["t"], r["id"]) for r in rows.collect()}
    read = index.postings.join(index.probes(asked), "gram").count()
    assert read == 50 and index.candidates(asked).count() == 50
