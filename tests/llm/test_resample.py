from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from foliant.llm import resample as x
from foliant.llm.queries import op12_resampling

from .cases import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text: str | None, longest: int) -> list[str]:
    words = WORD.findall((text or "").translate(FOLD))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets=10_000, longest=1, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, longest)) for texts in ([d for _, d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        own = features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        rows.append((i, len(features(text, 1)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    eligible = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = eligible[: percent * len(eligible) // 100]
    return rows, [(r[0], r[4]) for r in drawn]


def check(got, docs, target, **named):
    rows, drawn = brute(docs, target, **named)
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=repr) == sorted(rows, key=repr)
    ranks = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranks] == list(range(1, len(drawn) + 1))
    assert [r[1:] for r in ranks] == drawn


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_against_brute_force(spark, longest):
    docs = [(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 60))) for i in range(300)]
    target = ["w3 W5 w8, w13!", None, "w3 w3"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = x.resample(documents(spark, docs).repartition(5), bench, buckets=500, longest=longest, percent=30).collect()
    check(got, docs, target, buckets=500, longest=longest, percent=30)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(x, "BLOCK", 10)
    docs = [(1, ""), (2, "a b"), (3, None), (4, "c " * 30), (5, ""), (6, "a"), (7, "")]
    bench = spark.createDataFrame([(1, "a c")], "item_id long, text string")
    check(x.resample(documents(spark, docs).coalesce(1), bench, percent=100, least=1).collect(), docs, ["a c"], percent=100, least=1)


def test_odd_rows(spark):
    long = "Straße É naïve " * 40_000
    docs = [(1, None), (2, ""), (3, long), (4, "same text " * 15), (4, "same text " * 15), (None, "same text " * 15), (None, None), *((9, "hot words " * 10) for _ in range(200)), (-5, "one\x00two THREE " * 20)]
    bench = spark.createDataFrame([(None, "three É"), (2, None)], "item_id long, text string")
    check(x.resample(documents(spark, docs), bench, percent=50).collect(), docs, ["three É", None], percent=50)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = [(i, "a b " * 15) for i in range(20)]
    assert x.resample(documents(spark, docs).limit(0), bench).count() == 0
    check(x.resample(documents(spark, docs), bench.limit(0)).collect(), docs, [])


def test_query_on_the_small_table(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows, drawn = brute(docs, [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    got = op12_resampling(spark, small).collect()
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == sorted((r[0], *r[2:]) for r in rows)
    assert [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
