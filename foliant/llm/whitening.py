"""Embedding whitening by hierarchical SVD merging.

Each partition of the distinct vectors keeps a count, exact sums, and all singular values and right vectors of its centred
rows. Two summaries merge by stacking their scaled vectors, a row that corrects for the distance of their means, and a new
SVD; since no dimension is cut on the way, the last summary is the SVD of all centred rows. Summaries merge in groups of
FAN, level by level, so that no task sees more than FAN of them.

Entries are taken as x = floor(64 c) + 1,000,000. Sums are whole numbers of any size; rows are centred by the whole part of
the mean first, in integers, and by its fraction then, so the large offset costs no digits.

Defined results: rows whose vector is null, or holds a null, a NaN, an infinity or an entry whose x doesn't fit a long, are
left out; so are empty vectors, which have no component. Vectors of each length form a space of their own, with its own
fit. Repeated vectors count once in the fit and are whitened row by row; a null id stays null. Components whose singular
value is under 1e-11 of the largest can't be scaled to unit variance and are not returned: a space of a single distinct
vector has none. deviation is null where it doesn't fit a long. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialise, scratch

# Fixed values of the contract.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Summaries that meet in one task.
FAN = 16
#: Rows that a partition takes into its SVD at a time.
ROWS = 4096
#: Singular values under this share of the largest count as zero.
ZERO = 1e-11

SUMMARY = "dim int, part int, n long, sums array<string>, singular array<double>, vectors array<double>"
MOMENTS = "dim int, part int, n long, mean array<double>, products array<double>"
_PART = [("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int64())]
SUMMARY_ARROW = pa.schema([*_PART, ("sums", pa.list_(pa.string())), ("singular", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])
MOMENTS_ARROW = pa.schema([*_PART, ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])


@dataclass
class Summary:
    """n rows of a space: their exact sums, and singular values and right vectors of the rows less their mean."""

    n: int
    sums: list[int]
    singular: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of the rows of an integer matrix."""
        sums = exact_sums(x)
        singular, vectors = thin_svd(centred(x, len(x), sums))
        return cls(len(x), sums, singular, vectors)

    def merge(self, other: Summary) -> Summary:
        n, m = self.n, other.n
        apart = np.array([(a * m - b * n) / (n * m) for a, b in zip(self.sums, other.sums, strict=True)])
        stack = [self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, np.sqrt(n * m / (n + m)) * apart[None, :]]
        singular, vectors = thin_svd(np.vstack(stack))
        return Summary(n + m, [a + b for a, b in zip(self.sums, other.sums, strict=True)], singular, vectors)

    def row(self, dim: int, part: int) -> dict:
        return {"dim": dim, "part": part, "n": self.n, "sums": [str(s) for s in self.sums], "singular": self.singular.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def read(cls, r) -> Summary:
        singular = np.asarray(r.singular, dtype=float)
        return cls(int(r.n), [int(s) for s in r.sums], singular, np.asarray(r.vectors, dtype=float).reshape(len(singular), -1))


def exact_sums(x: np.ndarray) -> list[int]:
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(v) for h, v in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean sums / n: its whole part in integers, then the rest."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def thin_svd(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors; tall stacks are first turned into a triangle of the same ones."""
    if rows.shape[0] > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, singular, vectors = np.linalg.svd(rows, full_matrices=False)
    return singular, vectors


def quantised(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x) of the rows that stay."""
    v = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**56))
    return df.where(usable & (F.size(vector) > 0)).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * SCALE) + F.lit(OFFSET)).alias("x"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) for each length of the vectors of column x."""
    x = batch.column("x")
    flat, lengths = x.flatten().to_numpy(zero_copy_only=False), x.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)]


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, kept, waiting = TaskContext.get().partitionId(), {}, {}

    def take(dim: int) -> None:
        new = Summary.of(np.concatenate(waiting.pop(dim)))
        kept[dim] = kept[dim].merge(new) if dim in kept else new

    for b in batches:
        for _, x in matrices(b):
            dim = x.shape[1]
            for at in range(0, len(x), ROWS):
                waiting.setdefault(dim, []).append(x[at : at + ROWS])
                if sum(map(len, waiting[dim])) >= ROWS:
                    take(dim)
    for dim in list(waiting):
        take(dim)
    if kept:
        yield pa.RecordBatch.from_pylist([s.row(dim, part) for dim, s in kept.items()], schema=SUMMARY_ARROW)


def merged(rows: pd.DataFrame) -> pd.DataFrame:
    """A level of the tree: FAN summaries or fewer into one, in the order of their partitions."""
    rows = rows.sort_values("part")
    out = None
    for r in rows.itertuples():
        out = Summary.read(r) if out is None else out.merge(Summary.read(r))
    return pd.DataFrame([out.row(int(rows["dim"].iloc[0]), int(rows["part"].iloc[0]) // FAN)])


def added(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts, means and centred products of FAN parts or fewer, as one."""
    rows = rows.sort_values("part")
    n, mean, products = 0, 0.0, 0.0
    for r in rows.itertuples():
        m, other = int(r.n), np.asarray(r.mean, dtype=float)
        apart = other - mean
        products = products + np.asarray(r.products, dtype=float).reshape(len(other), len(other)) + np.outer(apart, apart) * (n * m / (n + m))
        mean = mean + apart * (m / (n + m))
        n += m
    return pd.DataFrame([{"dim": int(rows["dim"].iloc[0]), "part": int(rows["part"].iloc[0]) // FAN, "n": n, "mean": mean.tolist(), "products": products.ravel().tolist()}])


def folded(parts: DataFrame, level: Callable[[pd.DataFrame], pd.DataFrame], schema: str, name: str) -> DataFrame:
    """One row per space of a table of one row per space and partition."""
    parts = materialise(parts, name)
    width = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while width > 1:
        parts = parts.groupBy("dim", F.floor(F.col("part") / FAN).alias("of")).applyInPandas(level, schema)
        width = -(-width // FAN)
    return parts


@dataclass(frozen=True)
class Space:
    """The fit of one length of vectors: exact sums of n distinct ones, components as columns scaled to unit variance."""

    n: int
    sums: list[int]
    scaled: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def of(cls, s: Summary, components: int) -> Space:
        keep = int(np.sum(s.singular[:components] > ZERO * s.singular[0])) if s.singular[0] > 0 else 0
        vectors = s.vectors[:keep]
        sign = np.sign(vectors[np.arange(keep), np.abs(vectors).argmax(axis=1)]) if keep else np.ones(0)
        values = s.singular**2 / s.n
        return cls(s.n, s.sums, (vectors * sign[:, None]).T / np.sqrt(values[:keep]), values[:keep] / max(values.sum(), np.finfo(float).tiny))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.scaled

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over the dimensions of (n x - S)^2, exactly; null beyond a long."""
        whole, rest = np.array([s // self.n for s in self.sums], dtype=np.int64), [s % self.n for s in self.sums]
        near = x - whole
        if x.shape[1] * (self.n * (float(np.abs(near).max(initial=0)) + 1)) ** 2 < 2.0**62:
            return ((near * self.n - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near]
        return [e if e < 1 << 63 else None for e in exact]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Space]:
    """The spaces of a table, by length. Only a mean and `components` directions of each come to the driver."""
    spark = df.sparkSession
    with scratch(spark):
        distinct = materialise(quantised(df, vector, vector).select("x").distinct(), "vectors")
        rows = folded(distinct.mapInArrow(summarise, SUMMARY), merged, SUMMARY, "summaries")
        spaces = {r.dim: Space.of(Summary.read(r), components) for r in rows.toLocalIterator()}

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, kept = TaskContext.get().partitionId(), {}
            for b in batches:
                for _, x in matrices(b):
                    w = spaces[x.shape[1]].whiten(x)
                    mean = w.mean(axis=0)
                    one = {"dim": x.shape[1], "part": part, "n": len(w), "mean": mean.tolist(), "products": ((w - mean).T @ (w - mean)).ravel().tolist()}
                    kept[x.shape[1]] = added(pd.DataFrame([kept[x.shape[1]], one])).to_dict("records")[0] | {"part": part} if x.shape[1] in kept else one
            if kept:
                yield pa.RecordBatch.from_pylist(list(kept.values()), schema=MOMENTS_ARROW)

        for r in folded(distinct.mapInArrow(moments, MOMENTS), added, MOMENTS, "moments").collect():
            s = spaces[r.dim]
            k = s.scaled.shape[1]
            error = float(np.abs(np.asarray(r.products).reshape(k, k) / r.n - np.eye(k)).max(initial=0.0))
            spaces[r.dim] = Space(s.n, s.sums, s.scaled, s.explained, error)
    return spaces


def whiten(df: DataFrame, spaces: dict[int, Space], id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per row of df and component, of which the first explains most."""
    rows = quantised(df, id_col, vector)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in matrices(b):
                s = spaces.get(x.shape[1])
                k = s.scaled.shape[1] if s else 0
                if not k:
                    continue
                count, dev = len(x), pa.array(s.deviation(x), pa.int64())
                each = np.repeat(np.arange(count), k)
                columns = [
                    b.column("id").take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, s.n)), dev.take(pa.array(each)),
                    pa.array(s.whiten(x).ravel()), pa.array(np.tile(s.explained, count)), pa.array(np.full(count * k, s.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(score, schema)
