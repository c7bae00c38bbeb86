from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import near_dedup as x

from .cases import documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.lists(st.integers(0, 4), max_size=60), st.integers(0, 60))
def test_banded_distance(a, b, most):
    assert x.edit_distance(a, b, most) == min(distance(a, b), most + 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.lists(st.integers(0, 9), max_size=40))
def test_bounds_never_exceed_the_distance(a, b):
    one, two = np.array(a, np.uint32), np.array(b, np.uint32)
    d = distance(a, b)
    assert x.least_distance(one, two) <= d
    h, g = (np.frombuffer(x.histogram(v), np.uint8).astype(int) for v in (one, two))
    off = abs(len(a) - len(b))
    assert np.abs(h - g)[: x.HISTOGRAM].sum() + off <= 2 * d
    assert np.abs(h - g)[x.HISTOGRAM :].sum() + off <= 4 * d


def near(a: str, b: str) -> bool:
    v, w = (x.WORD.findall(t.lower()) for t in (a, b))
    return a == b or (bool(v) and bool(w) and distance(v, w) <= int(0.2 * max(len(v), len(w)) + 1e-9))


def brute(rows):
    """Classes over all pairs, by repeated merging; a class is named by its least doc_id."""
    texts = sorted({t or "" for _, t in rows})
    own = dict(zip(texts, range(len(texts)), strict=True))
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if own[a] != own[b] and near(a, b):
                old, new = own[a], own[b]
                own.update({t: new for t in texts if own[t] == old})
    least = {}
    for i, t in rows:
        k = own[t or ""]
        least[k] = min([v for v in (least.get(k), i) if v is not None], default=None)
    return sorted(((i, least[own[t or ""]], i == least[own[t or ""]]) for i, t in rows), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = rng.choice(VOCABULARY)
        elif kind < 0.7:
            words.insert(at, rng.choice(VOCABULARY))
        elif len(words) > 1:
            del words[at]
    return words


VOCABULARY = [f"word{i}" for i in range(2000)]


def made(groups=12, copies=6):
    rng, rows, n = random.Random(2), [], 1
    for g in range(groups):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randint(60, 120))]
        for c in range(copies):
            rows.append((n, " ".join(base if c == 1 else edited(rng, base, c % 4))))
            n += 1
    rows += [(n + i, " ".join(rng.choice(VOCABULARY) for _ in range(50))) for i in range(30)]
    rows += [(500, None), (501, ""), (502, "!!"), (503, "!!"), (504, "one two"), (505, "One, two"), (None, rows[0][1]), (3, rows[2][1]), (None, "no id here at all")]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "class_id", "kept").collect()), key=repr)


def test_against_brute_force(spark):
    rows = made()
    assert got(x.near_duplicates(documents(spark, rows))) == brute(rows)


def test_one_text_that_most_rows_vary(spark, monkeypatch):
    """A hot group over several blocks, with the broadcasts turned off."""
    monkeypatch.setattr(x, "BLOCK", 8)
    monkeypatch.setattr(x, "small_or_not", lambda df: df)
    rng = random.Random(4)
    base = [rng.choice(VOCABULARY) for _ in range(40)]
    rows = [(1000 + i, " ".join(edited(rng, base, i % 3))) for i in range(90)] + made(4, 3)
    assert got(x.near_duplicates(documents(spark, rows))) == brute(rows)


def test_order_counts(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[30:] + words[:30])), (3, " ".join(words[:55]))]
    assert got(x.near_duplicates(documents(spark, rows))) == [(1, 1, True), (2, 2, True), (3, 1, False)]


@pytest.mark.parametrize("rows", [[], [(1, "alone")], [(None, None)]])
def test_small_tables(spark, rows):
    assert got(x.near_duplicates(documents(spark, rows))) == brute(rows)


def test_very_long_text(spark):
    rng = random.Random(9)
    long = [rng.choice(VOCABULARY) for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(edited(rng, long, 20))), (3, " ".join(long[:30_000]))]
    assert got(x.near_duplicates(documents(spark, rows))) == [(1, 1, True), (2, 1, False), (3, 3, True)]


def spread(rng, n, share):
    """A text of n fresh words and its copy with a share of them substituted, as evenly as can be: no long run is left."""
    words = [f"x{rng.randrange(10**12)}" for _ in range(n)]
    edits = int(share * n + 1e-9)
    at = {int((i + 0.5) * n / edits) for i in range(edits)}
    return words, [f"y{rng.randrange(10**12)}" if i in at else w for i, w in enumerate(words)]


def found(spark, pairs):
    rows = [(2 * i + j, " ".join(t)) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    kept = {r["doc_id"] for r in x.near_duplicates(documents(spark, rows)).where("kept").collect()}
    return [2 * i + 1 not in kept for i in range(len(pairs))]


def test_scattered_edits_down_to_the_threshold(spark):
    rng = random.Random(12)
    pairs = [spread(rng, n, edits) for n in (41, 60, 100, 250, 1000) for edits in (0.05, 0.1, 0.15, 0.2) for _ in range(10)]
    assert all(near(" ".join(a), " ".join(b)) for a, b in pairs[:80])
    assert all(found(spark, pairs))


def test_short_texts_are_exact(spark):
    rng, rows = random.Random(13), []
    for _ in range(400):
        base = [f"x{rng.randrange(10**12)}" for _ in range(rng.randint(1, 40))]
        rows += [" ".join(t) for t in (base, edited(rng, base, rng.randint(1, max(1, len(base) // 5))))]
    rows = list(enumerate(rows))
    assert got(x.near_duplicates(documents(spark, rows))) == sorted(
        (r for i in range(0, len(rows), 2) for r in brute(rows[i : i + 2])), key=repr
    )


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9))
def test_short_links_share_a_key(seed):
    rng = random.Random(seed)
    base = [rng.choice("abcdef") for _ in range(rng.randint(1, 40))]
    a, b = " ".join(base), " ".join(edited(rng, base, rng.randint(0, 9)))
    one, two = (keys(x.word_hashes(t), seed) for t in (a, b))
    assert not near(a, b) or len(b.split()) > 40 or one & two


def keys(words, seed):
    """A text's keys where runs have made frequencies, many of them equal."""
    out = set(x.sketch(words).tolist())
    for k in (2, 3):
        runs = x.short_runs(words, k).view(np.int64).tolist()
        if runs:
            out |= set(x.rare_prefix([(2 + hash((key, seed)) % 4, key, at) for at, key in enumerate(runs)], k))
    return out


def test_spared_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        k, places = rng.choice((2, 3)), rng.sample(range(9), rng.randint(0, 6))
        least = next(n for n in range(10) for hit in itertools.combinations(range(11), n) if all(any(p <= h < p + k for h in hit) for p in places))
        assert x.spared(places, k) == least


def test_a_phrase_of_all_short_texts_is_no_key(spark):
    """Texts of 6 to 40 words that end alike and share nothing else have no bucket; near copies of some are found."""
    rng = random.Random(21)
    texts = [" ".join([*(f"x{rng.randrange(10**12)}" for _ in range(3 + i % 35)), "all", "rights", "reserved"]) for i in range(3000)]
    rows = x.sketch_rows(documents(spark, list(enumerate(texts)))).withColumnRenamed("doc_id", "node")
    assert rows.where("size(twos) + size(threes) > 0").count() == 3000 and x.rare_keys(rows).count() == 0
    near_copies = [(3000 + i, t.replace("reserved", "preserved")) for i, t in enumerate(texts[:70])]
    kept = {r["doc_id"]: r["class_id"] for r in x.near_duplicates(documents(spark, [*enumerate(texts), *near_copies])).collect()}
    assert all(kept[i] == i for i in range(3000)) and all(kept[i] == i - 3000 for i, _ in near_copies)


def test_components_of_paths_stars_and_random_links(spark):
    rng = np.random.default_rng(5)
    path = [(i, i + 1) for i in range(100, 140)]
    zigzag = [(200 + (i % 2) * 50 + i // 2, 200 + ((i + 1) % 2) * 50 + (i + 1) // 2) for i in range(60)]
    star = [(399, i) for i in range(300, 340)]
    links = path + zigzag + star + [(int(a), int(b)) for a, b in rng.integers(500, 700, (90, 2))] + [(7, 7), (9, 8), (8, 9)]
    parent = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = x.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["label"] for r in got} == {n: root(n) for n in list(parent)}
    assert x.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.lists(st.integers(0, 9), max_size=40))
def test_numbered_words_count_what_one_side_lacks(a, b):
    one, two = np.array(a, np.uint32), np.array(b, np.uint32)
    assert max(len(a), len(b)) - len(np.intersect1d(x.numbered(one), x.numbered(two), assume_unique=True)) == x.least_distance(one, two)


@pytest.fixture
def hot(spark, monkeypatch):
    """A bucket of one large component and 40 nodes of their own, as (node, key) rows, labels and words; and its similar pairs across labels."""
    rng = random.Random(31)
    base = [rng.choice(VOCABULARY) for _ in range(60)]
    texts = {i: edited(rng, base, i % 4 if i < 60 else 5 + i % 20) for i in range(100)}
    names = {i: " ".join(t) for i, t in texts.items()}
    want = {(i, j) for i in texts for j in texts if max(i, 59) < j and near(names[i], names[j])}
    labels = spark.createDataFrame([(i, 0) for i in range(60)], "node long, label long")
    words = x.materialise(x.word_rows(spark.createDataFrame(list(names.items()), "node long, text string")), "words")
    monkeypatch.setattr(x, "BLOCK", 8)
    return labels, words, want


@pytest.mark.parametrize("partitions", [1, 13])
def test_links_of_a_bucket_do_not_hang_on_the_partitions(spark, hot, partitions):
    """A block's two sides must meet in one task, whatever the number of tasks."""
    labels, words, want = hot
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = x.mixed_buckets(spark.range(100).selectExpr("7L AS key", "id AS node"), labels)
        got = {tuple(r) for r in x.residual_links(mixed, words, x.SIMILARITY).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert want and got == want


def test_buckets_of_one_component_are_one_where_that_makes_fewer_pairs(spark, hot):
    labels, _, _ = hot
    same = spark.range(100).selectExpr("explode(sequence(1000L, 1029L)) AS key", "id AS node")  # thirty buckets of the same nodes
    apart = spark.createDataFrame([(1, 0), (1, 2), (1, 60), (2, 1), (2, 3), (2, 61)], "key long, node long")  # buckets that share none, of the same component
    assert {(r["key"], r["node"]) for r in x.mixed_buckets(same, labels).collect()} == {(0, i) for i in range(100)}
    rows = x.mixed_buckets(apart, labels).collect()
    assert {(r["key"], r["node"], r["main"], r["held"]) for r in rows} >= {(1, 60, False, 3), (2, 61, False, 3)} and len(rows) == 6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40), st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_lower_halves_of_words_give_bounds(a, b):
    one, two = (np.array(v, np.uint32) for v in (a, b))
    assert x.whole(*x.halves(one)).tolist() == a
    low = [x.lower_half(x.halves(v)[0]) for v in (one, two)]
    assert x.histogram(low[0]) == x.histogram(one)
    assert x.least_distance(*low) <= x.least_distance(one, two)


def test_words_are_written_once_and_sketches_go_early(spark, monkeypatch):
    """Tables of buckets, bands and blocks hold no words, and the keys of all texts are gone before words are aligned."""
    wide, gone, write, drop = set(), [], x.materialise, x.discard

    def written(df, name, *more):
        if {"words", "counts", "low", "high"} & set(df.columns):
            wide.add(name)
        if name == "words":
            gone.append("words")
        return write(df, name, *more)

    monkeypatch.setattr(x, "materialise", written)
    monkeypatch.setattr(x, "discard", lambda df: (gone.extend(f.split("/foliant-")[1].split("-")[0] for f in df.inputFiles()[:1] if "/foliant-" in f), drop(df)))
    rows = made(4, 3)
    assert got(x.near_duplicates(documents(spark, rows))) == brute(rows)
    assert wide == {"words"} and gone.index("sketches") < gone.index("words")
