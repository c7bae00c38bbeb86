"""Shared helpers: tables, the shared scratch folder, samples, joins that check a size."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.runtime import make_importable

_WORKER: dict = {}

#: A side of at most so many bytes, counted before, may be broadcast.
BROADCAST_BYTES = 64 << 20


class _Scopes(threading.local):
    """Paths of the scratch tables of the scopes that a thread has open, the innermost last."""

    def __init__(self) -> None:
        self.paths: list[list[str]] = []


_SCOPES = _Scopes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder (in folders by a column, if asked) and read it back: the lineage ends there and a
    lost executor costs no recomputation. The table goes with the scope it was made in, if any."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/foliant-{name}-{uuid.uuid4().hex}"
    if _SCOPES.paths:
        _SCOPES.paths[-1].append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    for name in {f[: f.index("/", f.rindex("/foliant-") + 1)] for f in df.inputFiles() if "/foliant-" in f}:
        delete(df.sparkSession, name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables materialised within are deleted at the end, failures included."""
    _SCOPES.paths.append([])
    try:
        yield
    finally:
        for path in _SCOPES.paths.pop():
            delete(spark, path)


def settled(name: str) -> Callable:
    """Of a function that returns a table of a row per document or line: write the result and delete all its other
    scratch tables. The result goes with the scope that the call is in, or else when the driver ends."""

    def wrap(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(make)
        def call(first: DataFrame, *args, **named) -> DataFrame:
            spark = first.sparkSession
            with scratch(spark):
                done = materialise(make(first, *args, **named), name)
                path = _SCOPES.paths[-1].pop()
            if _SCOPES.paths:
                _SCOPES.paths[-1].append(path)
            else:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
            return done

        return call

    return wrap


def hash_sample(df: DataFrame, key: str, rows: int, total: int | None = None) -> DataFrame:
    """About `rows` rows of df, chosen by a hash of `key`, so the same rows whatever the partitioning."""
    total = df.count() if total is None else total
    if total <= rows:
        return df
    steps = 1 << 20
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(steps)) < math.ceil(steps * rows / total))


def row_bytes(df: DataFrame) -> Column:
    """About the bytes a row takes."""
    sizes = [F.lit(16 * (1 + len(df.columns)))]
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(name), F.lit(0)))
        elif kind.startswith("array<string"):
            sizes.append(F.coalesce(F.aggregate(name, F.lit(0), lambda a, x: a + 16 + F.octet_length(x)), F.lit(0)))
        elif kind.startswith("array"):
            sizes.append(F.coalesce(F.size(name) * 8, F.lit(0)))
    return sum(sizes[1:], sizes[0])


def small_or_not(df: DataFrame) -> DataFrame:
    """Hint a broadcast of a written table if its counted bytes are within BROADCAST_BYTES; beyond, Spark shuffles both
    sides."""
    size = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def worker_cache(key, make):
    """The one cache a Python worker keeps between its tasks. Another key's replaces it, so that operators that run one
    after the other in the same worker don't add up their memory."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def drop_rows(docs: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs without the rows (left_semi: only the rows) whose doc_id (null equals null) and text are in gone (doc_id, text_sha256)."""
    gone = materialise(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct(), "drop")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("gone_id")) & (F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256) == F.col("gone_sha"))
    return docs.join(small_or_not(gone), same, how)


def body(column: str = "text") -> Column:
    """The text column as string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_digest(column: str = "text") -> Column:
    """text_sha256, which with doc_id names a row."""
    return F.sha2(body(column).cast("binary"), 256).alias("text_sha256")


#: Bytes of words (digits, a-z, all of other letters) as they are, A-Z lower-cased, all others to spaces.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def byte_words(text: bytes) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
