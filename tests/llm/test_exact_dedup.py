from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import exact_dedup as x

from .cases import documents


def keys(n: int, salt: int) -> np.ndarray:
    return np.array([list(hashlib.sha256(f"{salt}/{i}".encode()).digest()) for i in range(n)], np.uint8).reshape(-1, 32)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 700), st.integers(0, 10**6))
def test_hash_is_minimal_and_perfect(n, salt):
    members = keys(n, salt)
    widths, bits, slots = x.build_hash(members)
    assert sorted(slots.tolist()) == list(range(n))
    stored = np.zeros_like(members)
    stored[slots] = members
    assert (x.probe(members, widths, bits, stored) == slots).all()
    assert (x.probe(keys(50, salt + 1), widths, bits, stored) == -1).all()


def test_keys_that_no_level_parts():
    members = keys(40, 1)
    members[20:, 8:24] = members[:20, 8:24]  # equal where the levels look
    widths, bits, slots = x.build_hash(members)
    assert sorted(slots.tolist()) == list(range(40))
    stored = np.zeros_like(members)
    stored[slots] = members
    assert (x.probe(members, widths, bits, stored) == slots).all()


def brute(rows):
    size = Counter(t or "" for _, t in rows)
    keep = {}
    for i, t in rows:
        t = t or ""
        keep[t] = i if keep.get(t) is None else keep[t] if i is None else max(keep[t], i)
    out = [(i, keep[t or ""], size[t or ""], i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


ROWS = [(1, "a"), (2, None), (3, ""), (4, "a "), (5, "a"), (5, "a"), (None, "a"), (None, "z"), (7, "A"), (8, "long " * 50_000), (9, "long " * 50_000)]
ROWS += [(i, f"copy {i % 3}") for i in range(20, 320)]


def test_against_brute_force(spark):
    df = documents(spark, ROWS)
    for cut in (0, 5, 100, 1000):  # all rows new, some of each, all historical
        old, new = df.where(f"doc_id <= {cut}"), df.where(f"doc_id > {cut} OR doc_id IS NULL")
        assert got(x.exact_dedup(old, new, shard_keys=4)) == brute(ROWS)
    assert got(x.dedup_table(df)) == brute(ROWS)


def test_empty(spark):
    df = documents(spark, [])
    assert got(x.dedup_table(df)) == []
