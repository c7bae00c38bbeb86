"""Exact dedup by a minimal perfect hash over historical distinct digests.

The history's texts are reduced to SHA-256 digests and grouped; the distinct digests are dealt to shards, and each
shard gets a minimal perfect hash: levels of bit arrays, a key resting on the first level where its position is its
own. The rank of that bit is the key's slot. A slot holds the full digest, the locator (doc_id) of the row that
stays and the number of rows. New rows, grouped by digest first, are looked up in their shard; a hit counts only if the
slot's 32 bytes equal the digest. Hits join the slot's group, the others form groups of their own.

Defined results: a null text counts as empty; a null doc_id never wins against another; rows that repeat a doc_id and
its text count once each in group_size and share one fate; a very long text is no more than its digest; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import body, materialise, settled

#: Digests of one shard: what a task holds at once when it builds or probes a hash.
SHARD_KEYS = 4096
MAX_LEVELS = 40
INDEX_SCHEMA = "shard long, levels binary, bits binary, digests binary, winners binary, counts binary"
GROUP_SCHEMA = "digest binary, keep_id long, group_size long"


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(digests.tobytes(), dtype="<u8").reshape(-1, 4)
    return both[:, 1].copy(), both[:, 2] | np.uint64(1)


def _positions(a: np.ndarray, b: np.ndarray, level: int, width: int) -> np.ndarray:
    x = a + np.uint64(level) * b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(width)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level widths, bits of all levels, slot of each key) for an (n, 32) array of distinct digests.

    Keys that MAX_LEVELS levels can't part (equal in 16 bytes) get the slots after the last bit, found by search.
    """
    n = len(digests)
    a, b = _words(digests)
    widths, bits, at = [], [], np.full(n, -1, dtype=np.int64)
    left, base = np.arange(n), 0
    while len(left) and len(widths) < MAX_LEVELS:
        width = len(left)
        pos = _positions(a[left], b[left], len(widths), width)
        alone = np.bincount(pos, minlength=width) == 1
        rests = alone[pos]
        at[left[rests]] = base + pos[rests]
        widths.append(width)
        bits.append(alone)
        left, base = left[~rests], base + width
    flat = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
    ranks = np.cumsum(flat) - 1
    slots = np.where(at >= 0, ranks[np.maximum(at, 0)] if n else at, -1)
    slots[left] = int(flat.sum()) + np.arange(len(left))
    return np.array(widths, dtype="<i8"), flat, slots


def probe(digests: np.ndarray, widths: np.ndarray, flat: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where the stored bytes differ: not a member."""
    n = len(digests)
    found = np.full(n, -1, dtype=np.int64)
    if not n or not len(stored):
        return found
    a, b = _words(digests)
    ranks, left, base = np.cumsum(flat) - 1, np.arange(n), 0
    for level, width in enumerate(widths):
        pos = base + _positions(a[left], b[left], level, int(width))
        rests = flat[pos]
        found[left[rests]] = ranks[pos[rests]]
        left, base = left[~rests], base + int(width)
    hit = found >= 0
    hit[hit] = (stored[found[hit]] == digests[hit]).all(axis=1)
    found[~hit] = -1
    extra = {stored[i].tobytes(): i for i in range(int(flat.sum()), len(stored))}
    for i in left if extra else ():
        found[i] = extra.get(digests[i].tobytes(), -1)
    return found


def _matrix(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(v) for v in values), dtype=np.uint8).reshape(-1, 32)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(rows["digest"])
    widths, flat, slots = build_hash(digests)
    order = np.argsort(slots)
    return pd.DataFrame(
        [
            {
                "shard": int(rows["shard"].iloc[0]),
                "levels": widths.tobytes(),
                "bits": np.packbits(flat).tobytes(),
                "digests": digests[order].tobytes(),
                "winners": rows["keep_id"].fillna(np.iinfo(np.int64).min).to_numpy().astype("<i8")[order].tobytes(),
                "counts": rows["group_size"].to_numpy().astype("<i8")[order].tobytes(),
            }
        ]
    )


_NONE = np.iinfo(np.int64).min


def _groups(digests: np.ndarray, winners: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    keep = pd.array(winners, dtype="Int64")
    keep[winners == _NONE] = pd.NA
    return pd.DataFrame({"digest": [d.tobytes() for d in digests], "keep_id": keep, "group_size": counts})


def _lookup_shard(index: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    new_digests = _matrix(rows["digest"])
    new_ids = rows["keep_id"].fillna(_NONE).to_numpy().astype(np.int64)
    new_counts = rows["group_size"].to_numpy().astype(np.int64)
    if not len(index):
        return _groups(new_digests, new_ids, new_counts)
    slot = index.iloc[0]
    widths = np.frombuffer(slot["levels"], dtype="<i8")
    flat = np.unpackbits(np.frombuffer(slot["bits"], dtype=np.uint8))[: int(widths.sum())].astype(bool)
    stored = np.frombuffer(slot["digests"], dtype=np.uint8).reshape(-1, 32)
    winners, counts = (np.frombuffer(slot[c], dtype="<i8").astype(np.int64) for c in ("winners", "counts"))
    found = probe(new_digests, widths, flat, stored)
    hit = found >= 0
    np.maximum.at(winners, found[hit], new_ids[hit])
    np.add.at(counts, found[hit], new_counts[hit])
    return pd.concat([_groups(stored, winners, counts), _groups(new_digests[~hit], new_ids[~hit], new_counts[~hit])])


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the 32-byte SHA-256 digest of the text in UTF-8."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(body(text).cast("binary"), 256)).alias("digest"))


def distinct_groups(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest; partial aggregation keeps a digest of a third of all rows to one row per map task."""
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select(shard, "digest", "keep_id", "group_size")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard with its minimal perfect hash and slots, from rows (doc_id, digest)."""
    return distinct_groups(history, shards).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def lookup(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size) of every digest of the index or of the new rows (doc_id, digest)."""
    new = distinct_groups(rows, shards)
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(_lookup_shard, GROUP_SCHEMA)


@settled("exact-dedup")
def dedup_rows(rows: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Rows (doc_id, digest, old) as (doc_id, keep_id, group_size, kept, text_sha256); `old` tells the history.

    The largest doc_id of equal texts stays. The last join is on the digest; its right side has one row per
    digest, so Spark's skew join can split the partition of a digest with very many rows.
    """
    rows = materialise(rows, "digests")
    shards = max(1, -(-rows.count() // shard_keys))
    index = materialise(build_index(rows.where("old"), shards), "mph")
    groups = lookup(index, rows.where("NOT old"), shards)
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(history: DataFrame, arrivals: DataFrame, text: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """dedup_rows() of a history and the rows that arrive after it."""
    parts = digests(history, text).withColumn("old", F.lit(True)).unionByName(digests(arrivals, text).withColumn("old", F.lit(False)))
    return dedup_rows(parts, shard_keys)


def dedup_table(docs: DataFrame, text: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """dedup_rows() of one table, whose ids up to the middle of their range are the history. The text is read once."""
    ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = ((ends[0] or 0) + (ends[1] or 0)) // 2
    return dedup_rows(digests(docs, text).withColumn("old", F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))), shard_keys)
