"""Toxicity by compression distance: one zstandard dictionary of toxic and one of ordinary text.

The toxic dictionary is trained on the windows that toxic documents have in excess, not on their running text: the README
gives the figures of both. Only letters count; digits and signs are no part of a window.

A window is one word with its borders, followed by a filler that both dictionaries hold, so that a match may start
anywhere in the word; the toxic one holds its windows with their fillers, so that a whole window is a single match. Its gain
is the compressed length under the ordinary dictionary less that under the toxic one, which knows the ordinary text as
well: ordinary words gain nothing or little, words of toxic text most of their bytes. A document is described by how many of
its windows reach each gain threshold; a logistic curve fitted on the labelled sample calibrates those counts to the
probability of the label. There is a pair of dictionaries for each part of the sample, trained on the other parts: the curve
is fitted on what each part's own pair tells of it, and a new text's score is the mean over the pairs.

Fitting reads a bounded sample: at most about `sample_rows` labelled rows, chosen by a hash of doc_id. Scoring reads
every row and whole texts, in one narrow stage without a shuffle.

Defined results: null and empty texts have no window and get the curve's value at zero; a very long text is read whole, its
windows counted one after the other; without labels of both kinds every score is the share of label 1 (0 without labels); an
empty documents table gives no rows; repeated rows are scored each; other columns are never inputs.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import body, hash_sample, text_digest, worker_cache

WORD = re.compile(r"[^\W\d_]+")
FILLER = b"0123456789ABCDEF"
LEVEL = 6
#: Gains, in bytes, at which windows are counted.
THRESHOLDS = (1, 2, 3, 4, 5, 6, 7, 8)
TOP = THRESHOLDS[-1]
FOLDS = 5
#: Parts of the labelled sample; each has dictionaries that were trained on the others.
INNER = 3
#: Distinct windows whose gain a Python worker remembers.
CACHE_WINDOWS = 400_000
#: Texts scored at once within an Arrow batch.
TEXTS = 256


@dataclass(frozen=True)
class Model:
    """Pairs of contents (ordinary, toxic), one for each part of the sample, trained on the other parts, and one curve for all."""

    pairs: tuple[tuple[bytes, bytes], ...]
    weights: tuple[float, ...]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Gains(dict):
    """Window -> its gains, clipped to 0..TOP, under each pair of dictionaries, as the digits of one number."""

    def __init__(self, pairs: tuple[tuple[bytes, bytes], ...]) -> None:
        super().__init__()
        self.pairs = [tuple(self._compressor(content) for content in pair) for pair in pairs]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content + FILLER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False
        )
        return zstandard.ZstdCompressor(compression_params=how, dict_data=held)

    def __missing__(self, word: str) -> int:
        window = f" {word} ".encode() + FILLER
        code = 0
        for ordinary, toxic in self.pairs:
            code = code * (TOP + 1) + min(TOP, max(0, len(ordinary.compress(window)) - len(toxic.compress(window))))
        if len(self) >= CACHE_WINDOWS:
            self.clear()
        self[word] = code
        return code


def features(words: list[str], gains: Gains) -> np.ndarray:
    """A row for each pair of dictionaries."""
    n = len(gains.pairs)
    counts = np.bincount(np.fromiter((gains[w] for w in words), dtype=np.int64, count=len(words)), minlength=(TOP + 1) ** n).reshape((TOP + 1,) * n)
    rows = []
    for k in range(n):
        own = counts.sum(axis=tuple(i for i in range(n) if i != k))
        reach = np.cumsum(own[::-1])[::-1][list(THRESHOLDS)].astype(float)
        share = reach / (len(words) + 20)
        rows.append(np.concatenate([[1.0, np.log1p(len(words)) / 8], np.sqrt(share), np.log1p(reach) / 4, 4 * share]))
    return np.array(rows)


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; too few samples to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=50, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Part:
    """Documents of the sample with what the dictionaries need of them."""

    docs: list[tuple[list[str], int]]

    def __post_init__(self) -> None:
        self.seen: tuple[Counter, Counter] = (Counter(), Counter())
        for words, toxic in self.docs:
            self.seen[toxic].update(set(words))
        self.rows = [sum(t == kind for _, t in self.docs) for kind in (0, 1)]
        self.ordinary = [f" {' '.join(words[i : i + 4])} ".encode() for words, toxic in self.docs if not toxic for i in range(0, len(words), 4)]


def _dictionaries(parts: list[Part], size: int, odds: float) -> tuple[bytes, bytes]:
    """Trained contents. Toxic samples are the windows over-represented in toxic documents (their share there at least `odds`
    times that in ordinary ones), as often as they occur there; ordinary samples are runs of four words of ordinary documents."""
    seen = [sum((p.seen[kind] for p in parts), Counter()) for kind in (0, 1)]
    rows = [sum(p.rows[kind] for p in parts) for kind in (0, 1)]
    sure = {w: k - math.sqrt(k) for w, k in seen[1].items() if k >= 2}  # a count less its own spread
    ratio = {w: (k / rows[1]) / ((seen[0][w] + 0.5) / rows[0]) for w, k in sure.items()}
    strange = sorted((w for w in ratio if ratio[w] >= odds), key=lambda w: (-seen[1][w], w))
    windows = [f" {w} ".encode() + FILLER for w in strange]
    toxic = [x for w, x in zip(strange, windows, strict=True) for _ in range(seen[1][w])]
    trained = _trained([b"".join(toxic[i::len(toxic) // 3 + 1]) for i in range(len(toxic) // 3 + 1)], size)
    missing, room = [x for x in windows if x not in trained], size  # the trainer cuts windows; the commonest of them are put behind
    while missing and sum(map(len, missing)) > room:
        missing.pop()
    return _trained([x for p in parts for x in p.ordinary], 4096), trained + b"".join(reversed(missing))


def fit_rows(rows: Iterable[tuple[str, int]], size: int = 4096, odds: float = 15.0) -> Model:
    """The model of labelled texts, the same for any order of the rows. A dictionary knows its own samples too well, so each of
    INNER parts of the sample is told by the dictionaries of the other parts, and the curve is fitted on that. New texts are
    scored under each of these pairs with the one curve, and the scores averaged: the curve meets what it was fitted on."""
    labelled: dict[bytes, tuple[str, int]] = {}
    for text, toxic in rows:
        mark = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
        labelled[mark] = (text, max(int(toxic), labelled.get(mark, ("", 0))[1]))
    shared: dict[str, str] = {}
    docs = [([shared.setdefault(w, w) for w in words_of(text)], toxic) for _, (text, toxic) in sorted(labelled.items())]
    y = np.array([t for _, t in docs], dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
        return Model((), (float(np.log(share / (1 - share))), *[0.0] * (1 + 3 * len(THRESHOLDS))))
    x = np.zeros((len(docs), 2 + 3 * len(THRESHOLDS)))
    parts = [Part(docs[i::INNER]) for i in range(INNER)]
    pairs = []
    for i, part in enumerate(parts):
        others = parts[:i] + parts[i + 1 :]
        mixed = all(sum(p.rows[kind] for p in others) for kind in (0, 1))
        ordinary, toxic = _dictionaries(others if mixed else parts, size, odds)
        pairs.append((ordinary, toxic + ordinary))
        gains = Gains((pairs[-1],))
        for k, (words, _) in enumerate(part.docs):
            x[i + k * INNER] = features(words, gains)[0]
    return Model(tuple(pairs), tuple(_curve(x, y)))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> Model:
    """Fit on rows outside the held-out fold. Labels beyond `sample_rows` are sampled by a hash of doc_id, so the
    broadcast side and the one task that fits are bounded by that parameter; only the model reaches the driver."""
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hash_sample(usable, "doc_id", sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fit_rows((t.as_py(), int(k.as_py())) for b in batches for t, k in zip(b.column("text"), b.column("toxic"), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m)])], names=["model"])

    rows = docs.select("doc_id", body().alias("text")).join(F.broadcast(chosen), "doc_id").repartition(1)
    fitted = rows.select("text", "toxic").mapInArrow(run, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else fit_rows([])


def score_texts(texts: Iterable[str], model: Model) -> np.ndarray:
    w = np.array(model.weights)
    if not model.pairs:
        at = np.zeros(len(w))
        at[0] = 1.0
        return np.full(len(list(texts)), 1 / (1 + np.exp(-np.clip(at @ w, -30, 30))))
    gains = worker_cache(model, lambda: Gains(model.pairs))
    x = np.array([features(words_of(t), gains) for t in texts]).reshape(-1, len(model.pairs), len(w))
    return (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).mean(axis=1)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, text_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                s = score_texts(part.column("text").to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), part.column("text_sha256")],
                    names=["doc_id", "held_out", "score", "predicted", "text_sha256"],
                )

    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), body(text).alias("text"), text_digest(text))
    return inputs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, text_sha256 string")
