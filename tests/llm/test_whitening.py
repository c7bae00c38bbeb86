from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import whitening as w
from foliant.llm.queries import op11_whitening

from .cases import clashing


def brute(rows: list[tuple], components: int = 16):
    """The contract step by step, with an eigendecomposition of the whole covariance."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.int64)
    n, sums = len(distinct), [int(s) for s in distinct.sum(axis=0)]
    y = distinct - np.array(sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        white = (np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(values)
        out += [(i, k + 1, n, dev, white[k], values[k] / np.trace(y.T @ y / n)) for k in range(len(values))]
    return out


def compare(got, want):
    got = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(want)
    sign = {}
    for i, k, n, dev, white, explained in want:
        r = got[i, k]
        assert (r["n"], r["deviation"]) == (n, dev)
        assert abs(r["explained"] / explained - 1) < 1e-9 and r["identity_error"] < 1e-6
        if abs(white) > 1e-3:
            assert sign.setdefault(k, np.sign(white * r["whitened"])) == np.sign(white * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(white)) < 1e-6


def table(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(None).cast("int"))
    return df.repartition(parts)


def gaussian(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dims, dims)) * np.linspace(3, 0.2, dims)
    return [[float(np.float32(v)) for v in row] for row in rng.normal(size=(n, dims)) @ mix]


@pytest.mark.parametrize("parts", [1, 40])  # more than FAN: two levels
def test_against_eigenvectors(spark, parts):
    rows = list(enumerate(gaussian(600, 20)))
    rows += [(1000 + i, v) for i, v in rows[:50]] + [(2000 + k, rows[0][1]) for k in range(300)]  # a vector in a third of the rows
    df = table(spark, rows, parts)
    compare(w.whiten(df, w.fit(df)).collect(), brute(rows))


def test_many_small_summaries_keep_all_dimensions(spark, monkeypatch):
    monkeypatch.setattr(w, "FAN", 2)
    rows = list(enumerate(gaussian(200, 12, seed=5)))
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows])
    parts = [w.Summary.of(x[k : k + 9]) for k in range(0, 200, 9)]
    while len(parts) > 1:
        parts = [parts[k] if k + 1 == len(parts) else parts[k].merge(parts[k + 1]) for k in range(0, len(parts), 2)]
    whole = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert parts[0].n == 200 and parts[0].sums == [int(s) for s in x.sum(axis=0)]
    assert len(parts[0].singular) == 12 and np.allclose(parts[0].singular, whole, rtol=1e-10)


def test_query_on_the_small_table(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    compare(op11_whitening(spark, small).collect(), brute(rows))


def test_odd_rows(spark):
    good = gaussian(40, 3)
    rows = list(enumerate(good)) + [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 1.0, 1.0]), (53, [float("inf"), 1.0, 1.0]), (54, []), (55, good[0]), (None, good[1])]
    df = clashing(table(spark, rows).drop("label"))
    got = w.whiten(df, w.fit(df)).collect()
    assert {r["vec_id"] for r in got} == {*range(40), 55, None} and all(r["n"] == 40 for r in got)
    want = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    assert all(want[0, k] == want[55, k] and want[1, k] == want[None, k] for k in (1, 2, 3))


def test_lengths_are_spaces_of_their_own(spark):
    a, b = gaussian(30, 3), gaussian(50, 5, seed=2)
    rows = list(enumerate(a)) + [(100 + i, v) for i, v in enumerate(b)]
    df = table(spark, rows)
    got = w.whiten(df, w.fit(df)).collect()
    compare([r for r in got if r["vec_id"] < 100], brute(list(enumerate(a))))
    compare([r for r in got if r["vec_id"] >= 100], brute([(100 + i, v) for i, v in enumerate(b)]))


def test_flat_spaces_and_empty_tables(spark):
    flat = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert w.whiten(flat, w.fit(flat)).count() == 0
    line = table(spark, [(k, [float(k), 2.0 * k]) for k in range(9)])
    got = w.whiten(line, w.fit(line)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    none = table(spark, [(1, [1.0])]).limit(0)
    assert w.whiten(none, w.fit(none)).count() == 0


def test_deviation_beyond_machine_words():
    s = w.Space(3, [3 * 10**15, 0], np.zeros((2, 0)), np.zeros(0))
    assert s.deviation(np.array([[10**15 + 7, 1], [10**15 + 3 * 10**9, 0], [0, 0]])) == [21**2 + 9, None, None]
    assert s.deviation(np.array([[10**15 + 10**9, 0]])) == [9 * 10**18]
