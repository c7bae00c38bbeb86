"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

The base patterns (assign, access, hex) report their matches as they stand. Besides, every other run of 16 or more key characters
(shorter ones tell too little) is scored: the log-likelihood of its character pairs under a model of random strings less that under a model of
ordinary identifiers, per character. Runs above the calibrated threshold are added as spans of kind `markov`; plain
numbers are left to the scan for personal data.

The models are fitted on labelled samples from a bounded, hash-chosen set of documents (`sample_rows`): what the base
patterns match is random, words and identifiers outside of matches are ordinary; seeded uniform strings over the usual
alphabets join the random side, so that a corpus without secrets trains a usable model. Scanning is one narrow stage
over every row and whole texts.

Defined results: null and empty texts have no spans (the digest of the empty text); a very long text is scanned whole, in time that grows with its length times the log of its secrets; an empty table
gives no rows; repeated rows are scanned each;
spans count code points, ends exclusive; ties of start order as assign, access, hex, markov.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import body, hash_sample

# Fixed patterns of the contract.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of fewer holds no match
KINDS = ("assign", "access", "hex", "markov")
TOKEN = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{16,}(?!\w)")
WORD = re.compile(r"[A-Za-z][A-Za-z0-9_-]{3,}")
ALPHABETS = (
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
)
SYMBOLS = 68  # letters of either case, digits, + / _ = -, and the border


def _codes() -> np.ndarray:
    codes = np.full(128, SYMBOLS - 1, dtype=np.int64)
    for i, c in enumerate(ALPHABETS[-1] + "_=-"):
        codes[ord(c)] = i
    return codes


CODES = _codes()


@dataclass(frozen=True)
class Markov:
    ratio: bytes  # SYMBOLS x SYMBOLS float64 log ratios of pairs
    threshold: float

    def score(self, token: str) -> float:
        return _score(np.frombuffer(self.ratio).reshape(SYMBOLS, SYMBOLS), token)


def _encode(token: str) -> np.ndarray:
    """Codes with a border at both ends."""
    codes = CODES[np.frombuffer(token.encode("ascii", "replace"), dtype=np.uint8) & 127]
    return np.concatenate([[SYMBOLS - 1], codes, [SYMBOLS - 1]])


def _score(ratio: np.ndarray, token: str) -> float:
    c = _encode(token)
    return float(ratio[c[:-1], c[1:]].mean())


def _model(tokens: Counter) -> np.ndarray:
    """Log probabilities of the next character, smoothed by a quarter of a count."""
    counts = np.full((SYMBOLS, SYMBOLS), 0.25)
    for token, n in tokens.items():
        c = _encode(token)
        np.add.at(counts, (c[:-1], c[1:]), n)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order of start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, overlapping ones put together, in order."""
    starts, ends = [], []
    for s, _, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _covered(merged: tuple[list[int], list[int]], start: int, end: int) -> bool:
    starts, ends = merged
    last = bisect_left(starts, end) - 1  # the last that starts before the end
    return last >= 0 and ends[last] > start


def train(texts: Iterable[str], seed: int = 7, drawn: int = 400) -> Markov:
    """Fit both models on all of the texts and place the threshold between the scores of their own samples."""
    rng = np.random.default_rng(seed)
    random, ordinary = Counter(), Counter()
    for text in texts:
        spans = base_spans(text)
        covered = _merged(spans)
        random.update(text[s:e] for s, kind, e in spans if kind)
        random.update(m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 16)
        ordinary.update(m[0] for m in WORD.finditer(text) if not _covered(covered, *m.span()))
    strings = ["".join(rng.choice(list(a), size=int(rng.integers(16, 65)))) for a in ALPHABETS for _ in range(drawn)]
    ratio = _model(random + Counter(strings)) - _model(ordinary)
    high = np.array([_score(ratio, t) for t in strings])
    low = np.array([_score(ratio, t) for t in ordinary if len(t) >= 10] or [0.0])
    bar = max(0.0, (np.quantile(high, 0.02) + np.quantile(low, 0.999)) / 2)
    return Markov(ratio.tobytes(), float(max(bar, low.max() * 0.9 if low.max() < np.quantile(high, 0.1) else bar)))


def fit(docs: DataFrame, sample_rows: int = 1500) -> Markov:
    rows = hash_sample(docs, "doc_id", sample_rows).select("doc_id", body().alias("text")).toPandas()
    return train(rows.sort_values(["doc_id", "text"])["text"])


def scan(text: str, model: Markov, known: dict[str, bool]) -> list[tuple[int, int, int]]:
    spans = base_spans(text)
    covered, added = _merged(spans), []
    for m in TOKEN.finditer(text):
        token = m[0]
        if token not in known:
            if len(known) > 100_000:
                known.clear()
            known[token] = not token.isdigit() and model.score(token) > model.threshold
        if known[token] and not _covered(covered, *m.span()):
            added.append((m.start(), 3, m.end()))
    return sorted(spans + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, model: Markov, text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t, model, known)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body(text).alias("text"))
    return inputs.mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans as text."""

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = found.withColumn("base", F.filter("spans", lambda s: s["kind"] != KINDS[3]))
    return base.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), count(KINDS[3]))
