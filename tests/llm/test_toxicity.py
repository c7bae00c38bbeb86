from __future__ import annotations

import random
import zlib

from foliant.llm import toxicity as x

from .cases import documents

BAD = "grublox snarvik plethorg zwickle dronfat".split()
GOOD = "river stone house garden winter summer letter window bridge morning paper candle".split()


def text(rng: random.Random, toxic: bool) -> str:
    words = [rng.choice(GOOD) for _ in range(60)]
    for i in range(0, 60, 9) if toxic else ():
        words[i] = rng.choice(BAD)
    return " ".join(words)


def rows(n: int):
    rng = random.Random(3)
    return [(i, text(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(n)]


def test_learns_and_holds_out(spark):
    made = rows(400)
    docs = documents(spark, [(i, t) for i, t, _ in made])
    labels = spark.createDataFrame([(i, None, y) for i, _, y in made], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in x.score(docs, x.fit(docs, labels)).collect()}
    assert len(got) == 400
    for i, _, y in made:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == y == int(got[i]["score"] >= 0.5)


def test_held_out_labels_are_not_read(spark):
    made = rows(200)
    docs = documents(spark, [(i, t) for i, t, _ in made])
    schema = "doc_id long, toxic int"
    true = spark.createDataFrame([(i, y) for i, _, y in made], schema)
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in made], schema)
    assert x.fit(docs, true) == x.fit(docs, other)


def test_odd_rows(spark):
    model = x.fit_rows([(t, y) for _, t, y in rows(200)])
    odd = [(1, None), (2, ""), (None, "river stone"), (4, "river " * 100_000), (4, "river " * 100_000), (5, "123 !!"), (6, f"{BAD[0]} {BAD[1]} " * 20)]
    got = x.score(documents(spark, odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[1] == scores[2] < 0.5 < scores[6] and scores[4] < 0.5


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(1, "river"), (2, None)])
    assert [r["predicted"] for r in x.score(docs, x.fit(docs, none)).collect()] == [0, 0]
    empty = documents(spark, [])
    assert x.score(empty, x.fit(empty, none)).count() == 0
    one = spark.createDataFrame([(1, None, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert x.score(docs, x.fit(docs, one)).count() == 2


def test_order_of_rows_is_no_input():
    made = [(t, y) for _, t, y in rows(300)]
    model = x.fit_rows(made)
    for seed in range(3):
        random.Random(seed).shuffle(made)
        assert x.fit_rows(made + made[:40]) == model


def test_scores_against_a_plain_count():
    """Each pair's gains taken window by window, thresholds counted one by one, curves averaged."""
    import math

    model = x.fit_rows([(t, y) for _, t, y in rows(300)])
    for _, text_, _ in rows(40) + [(0, f"{BAD[0]} {BAD[3]} river " * 3, 1), (0, "unseen words entirely", 0), (0, "", 0)]:
        scores = []
        for pair in model.pairs:
            one = [x.Gains._compressor(content) for content in pair]
            words = x.words_of(text_)
            gains = [len(one[0].compress(f" {w} ".encode() + x.FILLER)) - len(one[1].compress(f" {w} ".encode() + x.FILLER)) for w in words]
            reach = [sum(g >= t for g in gains) for t in x.THRESHOLDS]
            share = [r / (len(words) + 20) for r in reach]
            inputs = [1.0, math.log1p(len(words)) / 8, *map(math.sqrt, share), *(math.log1p(r) / 4 for r in reach), *(4 * s for s in share)]
            scores.append(1 / (1 + math.exp(-sum(a * b for a, b in zip(inputs, model.weights, strict=True)))))
        assert abs(x.score_texts([text_], model)[0] - sum(scores) / len(scores)) < 1e-12


def test_held_out_rows_of_the_tables(spark):
    """On the held-out fold of a given table: few false alarms, most toxic rows found, by the query's own cut."""
    import os

    import pytest

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = x.score(docs, x.fit(docs, labels)).where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id").select("predicted", "toxic").collect()
    found = sum(r["predicted"] and r["toxic"] for r in got)
    false = sum(r["predicted"] and not r["toxic"] for r in got)
    assert found >= 0.75 * sum(r["toxic"] for r in got) and false <= 0.1 * found
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got)
