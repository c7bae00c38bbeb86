"""Target-distribution importance resampling by an external sort-count.

A first pass writes each block of documents as one packed stream of uint16 buckets with the documents' offsets in it. The
counts come from the streams: each is sorted and run-length encoded, and Spark adds up the runs. The gains, a number per
bucket, go back to the streams: a block gathers them and sums each document's stretch with np.add.reduceat. Texts are
read once.

Documents are drawn by the highest of weight plus Gumbel noise from a hash of the doc_id. Their ranks come from a range
partitioning of narrow rows: each partition numbers its rows, and the sizes of those before are added. Rows that tie in
score and doc_id are told apart by their place in the streams, so a doc_id that repeats in many rows is split as well.

Defined results: a null text has no words, weight 0; a null doc_id hashes as the empty text and sorts after all others at
a tie; repeated rows are each drawn on their own; a very long text is one long stretch of its own block; without documents
there are no rows, and without target texts the gains are those of counts of zero. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import body, byte_words, materialise, settled

#: Features in a block, but for one long document's.
BLOCK = 1 << 20
BLOCKS = pa.schema([("place", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("stream", pa.binary())])


def bucket_blocks(texts: DataFrame, id_col: str, buckets: int, longest: int) -> DataFrame:
    """(place, doc_ids, n_words, offsets, stream): blocks of documents, their features' buckets packed two bytes each, with
    each document's offset. place numbers a block's first document apart from all others."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("a bucket has two bytes")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        ids, words, offsets, parts, size, known = [], [], [], [], 0, {}

        def block() -> pa.RecordBatch:
            row = {"place": place, "doc_ids": ids, "n_words": words, "offsets": offsets, "stream": b"".join(p.tobytes() for p in parts)}
            return pa.RecordBatch.from_pylist([row], schema=BLOCKS)

        for b in batches:
            for doc, data in zip(b.column("id").to_pylist(), b.column("data"), strict=True):
                found = byte_words(data.as_py())
                runs = [found, *([b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)] for n in range(2, longest + 1))]
                taken = []
                for feature in (f for run in runs for f in run):
                    at = known.get(feature)
                    if at is None:
                        if len(known) >= 200_000:  # a cache, not a bound on what is counted
                            known.clear()
                        at = known[feature] = zlib.crc32(feature) % buckets
                    taken.append(at)
                ids.append(doc), words.append(len(found)), offsets.append(size), parts.append(np.array(taken, dtype="<u2"))
                size += len(taken)
                if size >= BLOCK or len(ids) >= 1 << 16:
                    yield block()
                    place, ids, words, offsets, parts, size = place + len(ids), [], [], [], [], 0
        if ids:
            yield block()

    schema = "place long, doc_ids array<long>, n_words array<long>, offsets array<long>, stream binary"
    return texts.select(F.col(id_col).cast("long").alias("id"), body().cast("binary").alias("data")).mapInArrow(pack, schema)


def bucket_counts(blocks: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs. Each stream is sorted and run-length encoded; at most a row a bucket comes back."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream in b.column("stream"):
                ordered = np.sort(np.frombuffer(stream.as_py(), dtype="<u2"))
                starts = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(ordered) else np.zeros(0, dtype=int)
                lengths = np.diff(starts, append=len(ordered))
                yield pa.RecordBatch.from_arrays([pa.array(ordered[starts].astype(np.int32)), pa.array(lengths.astype(np.int64))], ["bucket", "n"])

    counts = np.zeros(buckets, dtype=np.int64)
    for r in blocks.select("stream").mapInArrow(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.bucket] = r.n
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p_target / p_raw)) of each bucket, both smoothed by one."""
    m, s, t = len(raw), raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + m) / ((s + 1) * (t.sum() + m)))).astype(np.int64)


def weigh(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, place, n_words, n_features, weight): gains gathered along each stream and summed per document."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                stream, starts = np.frombuffer(r["stream"], dtype="<u2"), np.array(r["offsets"], dtype=np.int64)
                sizes = np.diff(starts, append=len(stream))
                weight, some = np.zeros(len(starts), dtype=np.int64), sizes > 0
                if some.any():
                    weight[some] = np.add.reduceat(gains[stream], starts[some])
                places = r["place"] + np.arange(len(starts))
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(places), pa.array(r["n_words"], pa.int64()), pa.array(sizes), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(gather, "doc_id long, place long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """floor(1000 g) of Gumbel noise g, the same for a doc_id whenever it is drawn."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows, in range partitions of `order` (which tells all apart), with their number in it from 1."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), slice_, dtype=np.int32)), pa.array(np.arange(n + 1, n + 1 + len(b)))], [*b.schema.names, "slice", "nth"])
            n += len(b)

    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    dealt = materialise(rows.repartitionByRange(slices, *order).sortWithinPartitions(*order).mapInArrow(number, f"{kinds}, slice int, nth long"), "ranks")
    sizes = {r[0]: r[1] for r in dealt.groupBy("slice").count().collect()}  # a row a partition
    before = dict(zip(sorted(sizes), accumulate([0, *(sizes[s] for s in sorted(sizes))]), strict=False))
    starts = rows.sparkSession.createDataFrame(list(before.items()), "slice int, start long")
    return dealt.join(F.broadcast(starts), "slice").withColumn("nth", F.col("nth") + F.col("start")).drop("slice", "start")


@settled("resampled")
def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """Every document with n_words, n_features, weight, score, and its rank if it is drawn: `percent` per cent of the
    documents of at least `least` words, towards the distribution of the target texts. Features are all runs of up to
    `longest` words."""
    blocks = materialise(bucket_blocks(docs, "doc_id", buckets, longest), "streams")
    wanted = bucket_counts(bucket_blocks(target.withColumn("_id", F.lit(0)), "_id", buckets, longest), buckets)
    gains = bucket_gains(bucket_counts(blocks, buckets), wanted)
    rows = materialise(weigh(blocks, gains).withColumn("score", F.col("weight") + gumbel(seed)), "weights")
    drawn = rows.where(F.col("n_words") >= least).count() * percent // 100
    order = [(F.col("n_words") >= least).desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place").asc()]
    out = ranked(rows, order).withColumn("rank", F.when(F.col("nth") <= drawn, F.col("nth")))
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")
