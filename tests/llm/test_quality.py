from __future__ import annotations

import random
from collections import Counter

from foliant.llm import quality as x

from .cases import documents


def test_accuracies_are_estimated():
    rng, true = random.Random(1), [0.9, 0.6, 0.8, 0.75, 0.9, 0.65, 0.85, 0.7, 0.8, 0.9]
    counts, classes = Counter(), Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        vote = "".join("1" if rng.random() < 0.3 else "02"[good == (rng.random() < a)] for a in true)
        counts[vote] += 1
        classes[vote, good] += 1
    labels = x.expectation_maximisation(dict(counts))
    assert abs(labels.prior - 0.7) < 0.03
    assert all(abs(got - want) < 0.04 for got, want in zip(labels.accuracies.values(), true, strict=True))
    right = sum(n for (v, good), n in classes.items() if (labels.posterior[v] >= 0.5) == good)
    assert right / 20_000 > 0.93


def test_labels_are_met(spark, small):
    """The scorer never sees the labels of the test tables; it has to agree with them all the same."""
    got = {r["doc_id"]: r["predicted"] for r in x.classify(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{small}/labels.parquet").collect()]
    assert sum(got[i] == q for i, q in labels) / len(labels) >= 0.95


def test_odd_rows(spark):
    text = "The house stands by the river, and the people of the town walk to it in the morning. They talk of the weather."
    rows = [(1, None), (2, ""), (3, text * 2000), (4, text), (4, text), (None, "!! $$$ ### !!"), (6, "A" * 100_000)]
    rows += [(10 + i, f"{text} Number {i}.") for i in range(20)] + [(40 + i, f"$$$ ### {i} %%% &&& *** !!") for i in range(10)]
    got = x.classify(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[1] == scores[2] and scores[4] > scores[40]
    assert x.classify(documents(spark, [])).collect() == []
    assert len(x.classify(documents(spark, [(1, "one row")])).collect()) == 1
