"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of
vote patterns estimates the labellers' accuracies; the patterns number at most three to
the power of the labellers, whatever the corpus, so their counts fit on the driver while covering every row. The posterior of a
pattern is the weak label. A linear scorer over hashed token shapes and pairs of neighbouring shapes is fitted to the weak labels
of a bounded, hash-chosen sample (`sample_rows`) and scores every document from its whole text.

Defined results: null and empty texts have the votes of an empty text and a score; a very long text is read whole; with no rows nothing is returned; one
vote pattern alone leaves its majority vote as the label; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import body, hash_sample, materialise, worker_cache

UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))
SYMBOLS = b"#$%&*<>^{}~|\\@=_+/"
DIGITS = b"0123456789"
STOPS = b"?!.:;\")'"
#: Common words of several languages, a fixed list.
COMMON = frozenset(w.encode() for w in "the of and to in is that for it as with on by at from de la le les et des en un une que el los y der die das und ist von zu den mit".split())
LABELLERS = ("symbols", "capitals", "outcry", "words", "variety", "echo", "ends", "size", "common", "cells")


def _bad(is_bad: bool) -> int:
    return -1 if is_bad else 0


def votes(text: str) -> tuple[int, ...]:
    """Most labellers know one fault and are silent otherwise; one also vouches for running text. Faults are seen by two."""
    raw = text.encode()
    size = max(1, len(raw))

    def share(of: bytes) -> float:
        return (len(raw) - len(raw.translate(None, of))) / size

    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = share(UPPER), share(LOWER)
    enough = len(words) >= 8
    ends = sum(x.rstrip()[-1:] in STOPS for x in lines) / max(1, len(lines))
    common = sum(w in COMMON for w in words) / n
    variety = len(set(words)) / n if len(words) >= 40 else 1.0
    return (
        _bad(share(SYMBOLS) > 0.04),
        _bad(upper > 0.5 * (upper + lower) and size > 20),
        _bad(raw.count(b"!!") / n > 0.1),
        _bad(enough and not 3.2 <= size / n <= 14),
        _bad(variety < 0.3),
        _bad(enough and sum(map(operator.eq, words, words[1:])) / n > 0.2),
        _bad(enough and ends < 0.15),
        _bad(len(words) < 2),
        (1 if common >= 0.06 and variety >= 0.3 else -1 if common < 0.01 else 0) if enough else 0,
        _bad(raw.count(b" | ") / n > 0.1),
    )


def vote_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pattern): a digit 0, 1, 2 for the vote -1, 0, 1 of each labeller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            patterns = ["".join("012"[v + 1] for v in votes(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(patterns, pa.string())], names=["doc_id", "pattern"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body(text).alias("text")).mapInArrow(run, "doc_id long, pattern string")


@dataclass(frozen=True)
class Labels:
    """The share of good documents, each labeller's accuracy where it votes, and each pattern's posterior of good."""

    prior: float
    accuracies: dict[str, float]
    posterior: dict[str, float]


def expectation_maximisation(counts: dict[str, int], steps: int = 200) -> Labels:
    """Votes are right with the labeller's accuracy, independently given the class; silence says nothing."""
    patterns = sorted(counts)
    cast = np.array([[int(c) - 1 for c in p] for p in patterns], float)
    n = np.array([counts[p] for p in patterns], float)
    accuracy, prior, good = np.full(cast.shape[1], 0.85), 0.8, None
    for _ in range(steps):
        odds = np.log(prior / (1 - prior)) + cast @ np.log(accuracy / (1 - accuracy))
        fresh = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        moved, good = np.inf if good is None else np.abs(fresh - good).max(), fresh
        if moved < 1e-7:
            break
        right = n @ ((cast == 1) * good[:, None] + (cast == -1) * (1 - good)[:, None])
        accuracy = np.clip((right + 8) / (n @ (cast != 0) + 10), 0.55, 0.95)
        prior = float(np.clip((n @ good + 8.5) / (n.sum() + 10), 0.05, 0.95))
    return Labels(prior, dict(zip(LABELLERS, accuracy.tolist(), strict=True)), dict(zip(patterns, good.tolist(), strict=True)))


SIZE = 2048
CACHE_TOKENS = 400_000
RUNS = ((re.compile(r"[^\W\d_a-z]*[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[^\W\d_X]+"), "x"), (re.compile(r"\d+"), "9"))


class Shapes(dict):
    """Token -> hashed shape: runs of capitals, of small letters and of digits are one sign each."""

    def __missing__(self, token: str) -> int:
        shape = token
        for run, sign in RUNS:
            shape = run.sub(sign, shape)
        if len(self) >= CACHE_TOKENS:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(shape) % SIZE
        return h


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the shapes and of the pairs of neighbours; equal neighbours have an id of their own."""
    tokens = text.split()
    shapes = worker_cache("shapes", Shapes)
    one = np.fromiter((shapes[t] for t in tokens), np.int64, len(tokens))
    two = (one[:-1] * 31 + one[1:] * 17 + 7) % SIZE
    if len(tokens) > 1:
        two[np.fromiter(map(operator.eq, tokens, tokens[1:]), bool, len(tokens) - 1)] = 0
    return one, two


def _spread(text: str) -> np.ndarray:
    one, two = hashed(text)
    return np.concatenate([np.bincount(x, minlength=SIZE) / max(1, len(x)) for x in (one, two)] + [[np.log1p(len(one)) / 8]]).astype(np.float32)


def fit_scorer(texts: Iterable[str], goals: Iterable[float], steps: int = 250) -> np.ndarray:
    """Weights of the logistic scorer, the last one the constant; full-batch steps with momentum and a small ridge."""
    x, y = np.stack([_spread(t) for t in texts]), np.array(list(goals), np.float32)
    w, bias = np.zeros(x.shape[1], np.float32), float(np.log((y.mean() + 1e-3) / (1.001 - y.mean())))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, steps + 1):
        wrong = 1 / (1 + np.exp(-(x @ w + bias))) - y
        slope = np.append(x.T @ wrong / len(y) + 1e-4 * w, wrong.mean())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - float(step[-1])
    return np.append(w, bias).astype(np.float64)


def classify(docs: DataFrame, text: str = "text", sample_rows: int = 5_000) -> DataFrame:
    """(doc_id, weak_label, score, predicted) of every row."""
    spark = docs.sparkSession
    cast = materialise(vote_rows(docs, text), "votes")
    counts = {r["pattern"]: r["count"] for r in cast.groupBy("pattern").count().collect()}
    if not counts:
        return spark.createDataFrame([], "doc_id long, weak_label double, score double, predicted int")
    labels = expectation_maximisation(counts)
    sample = hash_sample(docs, "doc_id", sample_rows, sum(counts.values())).select("doc_id", body(text).alias("text")).toPandas()
    texts = sample.sort_values(["doc_id", "text"])["text"].tolist() or [""]
    patterns = ["".join("012"[v + 1] for v in votes(t)) for t in texts]
    w = fit_scorer(texts, [labels.posterior.get(p, labels.prior) for p in patterns])
    posterior = labels.posterior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, weak = [], []
            for t in b.column("text").to_pylist():
                one, two = hashed(t)
                total = sum(float(w[at + x].mean()) for at, x in ((0, one), (SIZE, two)) if len(x))
                scores.append(total + w[2 * SIZE] * np.log1p(len(one)) / 8 + w[-1])
                weak.append(posterior.get("".join("012"[v + 1] for v in votes(t))))
            s = 1 / (1 + np.exp(-np.clip(np.array(scores, float), -40, 40)))
            columns = [b.column("doc_id"), pa.array(weak, pa.float64()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "weak_label", "score", "predicted"])

    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body(text).alias("text"))
    return inputs.mapInArrow(run, "doc_id long, weak_label double, score double, predicted int")
