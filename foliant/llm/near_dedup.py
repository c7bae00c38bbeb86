"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A document is its words (letters and digits, lower-cased); its k-mers are pairs of neighbouring words, labelled by how often
the pair occurred before. For each of SKETCHES hash functions, the three labelled k-mers of least hash are taken in text order: two
documents agree on such a triple roughly with the probability that edits spared all of it. Documents with an equal
triple are candidates, and a candidate pair is a link if its word edit similarity, 1 - distance / longer length, is 0.8
or more, found by an alignment that walks the diagonals within the band the threshold allows. An edit touches two pairs of
words, so texts of similarity 0.8 share 0.43 of their k-mers however the edits lie; such a pair agrees on none of the 96 triples
with a probability of about 0.001 at worst.

Short texts, of up to SHORT words, have an exact route. If the shorter text has l words, at most l / 4 edits part the two; of its disjoint
runs of three words (l >= 13) or two (l >= 4), more than l / 4, one is spared, and below 4 words the texts are equal. Only the rarest runs
of a text are its keys: in the order of how many texts hold a run, the least prefix that l / 4 edits can't wholly change. If two linked texts
had no key in common, the one whose prefix ends first would have lost all of it to the edits. So no linked pair of short texts is
missed, while a phrase that many share is a key only of texts that it makes up too much of.

Equal texts are one node, named by their smallest doc_id. A bucket (equal triple) is compared with its least node first, which
links the copies of a text without listing their pairs. A bucket that still spans several components is compared
across them: the nodes outside its main component meet those of the same or a neighbouring band of lengths, block by block, and a pair is aligned unless lengths,
histograms of words and word pairs or the words that one side lacks already prove it dissimilar. Buckets of one main component, which share most of their
nodes, are taken as one wherever that makes fewer pairs. So no candidate pair between different components
goes untested, while a task holds two blocks whatever the size of the bucket. Components are joined in rounds that hang each node below its
least neighbour and go on with the links between the trees, each round written to the shared folder.

Words move as seldom as they can: a text's words are written once, as lower and upper halves of their hashes. Buckets, bands and blocks are worked
out on narrow rows; the lower halves, which give the histograms as they are and the shared words nearly, are joined to the rows of the blocks
last. Both halves go only where a pair is aligned.

Defined results: null and empty texts equal each other and are one class; texts without words link to exact copies
only; rows that repeat a doc_id follow their text, and texts with the same smallest doc_id share their class; a null doc_id takes
the class of its text (null if no such row has an id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import body, discard, materialise, settled, small_or_not, worker_cache

WORD = re.compile(r"[^\W_]+")
K = 2
SIMILARITY = 0.8
SKETCHES = 96
TAKEN = 3
#: Pairs of texts of at most so many words are found by single runs; of texts under 0.8 SHORT words, no other partner can be longer.
SHORT = 40
HISTOGRAM = 128
#: Nodes of a bucket that meet the others of the bucket together.
BLOCK = 256
CACHE_WORDS = 400_000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = _mix(SEEDS) | np.uint64(1)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


class Words(dict):
    """Word -> 64-bit hash, the same on every machine."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str) -> np.ndarray:
    found, known = WORD.findall(text.lower()), worker_cache("words", Words)
    return np.fromiter((known[w] for w in found), np.uint64, len(found))


def plain_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words (a shorter text is one run)."""
    n = max(1, len(words) - k + 1) if len(words) else 0
    runs = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        runs = _mix(runs + words[j : j + n] + np.uint64(j + 1))
    return runs


def labelled_kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of K words, each mixed with the number of equal runs before it."""
    runs = plain_runs(words, K)
    n = len(runs)
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    if not fresh.all():
        at = np.arange(n)
        label = np.empty(n, np.uint64)
        label[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
        runs = _mix(runs + label * M2)
    return runs


def order_keys(words: np.ndarray) -> np.ndarray:
    """One key per hash function: its TAKEN labelled k-mers of least hash, in text order."""
    runs = labelled_kmers(words)
    keys = SEEDS.copy()
    step = max(1, 100_000 // len(runs))
    for i in range(0, SKETCHES, step):
        hashed = (runs ^ SEEDS[i : i + step, None]) * FACTORS[i : i + step, None]
        lines = np.arange(len(hashed))
        chosen = np.empty((len(hashed), min(TAKEN, len(runs))), np.int64)
        for j in range(chosen.shape[1]):
            chosen[:, j] = hashed.argmin(axis=1)
            hashed[lines, chosen[:, j]] = LAST
        chosen.sort(axis=1)
        for j in range(chosen.shape[1]):
            keys[i : i + step] = _mix(keys[i : i + step] + runs[chosen[:, j]])
    return keys


#: Run lengths of short texts by the number of words. A text of 12 words has partners of up to 15, one of 13 none below 11.
RUNS = ((2, 4, 15), (3, 13, SHORT))


def short_runs(words: np.ndarray, k: int) -> np.ndarray:
    """The runs of k words of a text whose length has such keys."""
    least, most = next((least, most) for of, least, most in RUNS if of == k)
    return _mix(plain_runs(words, k) + np.uint64(10 + k)) if least <= len(words) <= most else np.zeros(0, np.uint64)


def spared(places: list[int], k: int) -> int:
    """How many edits it takes at least to change all the runs of k words that start at these places."""
    edits, reach = 0, -1
    for at in sorted(places):
        if at > reach:
            edits, reach = edits + 1, at + k - 1
    return edits


def rare_prefix(runs: list[tuple[int, int, int]], k: int) -> list[int]:
    """Of (frequency, key, place), the fewest first in that order that a quarter of the words, edited, can't all change."""
    ordered, most = sorted(runs), (len(runs) + k - 1) // 4
    low, high = 1, len(ordered)
    while low < high:
        half = (low + high) // 2
        if spared([at for _, _, at in ordered[:half]], k) > most:
            high = half
        else:
            low = half + 1
    return [key for often, key, _ in ordered[:low] if often > 1]


def sketch(words: np.ndarray) -> np.ndarray:
    """The signed 64-bit keys of a text that don't hang on other texts: of all its words below 4, of triples of its k-mers beyond
    0.8 SHORT."""
    if not len(words):
        return np.zeros(0, np.int64)
    if len(words) < 4:
        return _mix(plain_runs(words, 3) + np.uint64(len(words))).view(np.int64)
    return np.unique(order_keys(words)).view(np.int64) if len(words) >= SIMILARITY * SHORT else np.zeros(0, np.int64)


def histogram(words: np.ndarray) -> bytes:
    """Counts of words and of pairs of neighbours by hash, up to 255, which keeps differences lower bounds."""
    pairs = (words[:-1] * np.uint32(0x9E3779B1) + words[1:] * np.uint32(0x85EBCA77)) >> np.uint32(8)
    both = [np.bincount(x % np.uint32(HISTOGRAM), minlength=HISTOGRAM) for x in (words, pairs)]
    return np.minimum(np.concatenate(both), 255).astype(np.uint8).tobytes()


def sketch_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, digest, buckets, twos, threes) of every row: its keys, and its runs of two and three words, in text order, if it is short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                words = [word_hashes(t) for t in part.column("text").to_pylist()]
                lists = [_lists([sketch(w) for w in words]), *(_lists([short_runs(w, k).view(np.int64) for w in words]) for k in (2, 3))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), *lists], names=["doc_id", "digest", "buckets", "twos", "threes"])

    return named_texts(docs, text).mapInArrow(run, "doc_id long, digest binary, buckets array<long>, twos array<long>, threes array<long>")


def _lists(keys: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)], dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *keys]))


def rare_keys(nodes: DataFrame) -> DataFrame:
    """(node, key) of (node, twos, threes): the runs of each short text's prefix that other texts hold too. The runs that occur once,
    most of them, are not in the table of frequencies; a text has at most SHORT runs of a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("node", "k", "runs")]
            kept = [(node, key) for node, k, runs in zip(*columns, strict=True) for key in set(rare_prefix([(r["often"], r["key"], r["at"]) for r in runs], k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], names=["node", "key"])

    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("keys")) for k, c in ((2, "twos"), (3, "threes"))])
    short = nodes.where("size(twos) + size(threes) > 0").select("node", F.inline(kinds)).select("node", "k", F.posexplode("keys").alias("at", "key"))
    often = materialise(short.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    ranked = short.join(small_or_not(often), "key", "left").groupBy("node", "k").agg(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "key", "at")).alias("runs"))
    return ranked.where(F.exists("runs", lambda r: r["often"] > 1)).select("node", "k", "runs").mapInArrow(run, "node long, key long")


def named_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(body(text).cast("binary"), 256)).alias("digest"), body(text).alias("text"))


def halves(words: np.ndarray) -> tuple[bytes, bytes]:
    """32-bit hashes as their packed lower and upper 16 bits."""
    return words.astype("<u2").tobytes(), (words >> np.uint32(16)).astype("<u2").tobytes()


def lower_half(low: bytes) -> np.ndarray:
    """The words by their lower 16 bits. Equal words stay equal, so what two texts share is never counted too low, and a histogram
    takes no higher bits: of a pair it takes bits 8 to 14 of a sum of products."""
    return np.frombuffer(low, "<u2").astype(np.uint32)


def whole(low: bytes, high: bytes) -> np.ndarray:
    return lower_half(low) | lower_half(high) << np.uint32(16)


def word_rows(texts: DataFrame) -> DataFrame:
    """(node, n_words, low, high) of (node, text): words as 32-bit hashes in two packed halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                short = [word_hashes(t).astype(np.uint32) for t in part.column("text").to_pylist()]
                packed = [halves(h) for h in short]
                columns = [pa.array([len(h) for h in short], pa.int64()), *(pa.array([x[i] for x in packed], pa.binary()) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([part.column("node"), *columns], names=["node", "n_words", "low", "high"])

    return texts.mapInArrow(run, "node long, n_words long, low binary, high binary")


def _near_diagonals(a: list[int], b: list[int], most: int) -> int:
    """Edit distance up to most, else most + 1: for each distance in turn, the furthest point of every diagonal within
    the band is extended along equal words."""
    n, m = len(a), len(b)
    goal, reach = m - n, {}
    for d in range(most + 1):
        fresh = {}
        for k in range(max(-d, goal - most + d, -n), min(d, goal + most - d, m) + 1):
            i = max(reach.get(k, -1) + 1, reach.get(k - 1, -1), reach.get(k + 1, -1) + 1) if d else 0
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            fresh[k] = i
        if fresh.get(goal, -1) >= n:
            return d
        reach = fresh
    return most + 1


def _bit_columns(a: list[int], b: list[int], most: int) -> int:
    """The same from columns of the alignment table, of which only the band of `most` rows above and below the diagonal is kept,
    as bits (rises and falls down the band): bit t of column j is row j - most + t. Cells outside of the band count as
    one more than their neighbours inside."""
    n, m = len(a), len(b)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << (2 * most + 1)) - 1, 1 << (2 * most)
    rise, fall, row = full & ~((1 << most) - 1), 0, min(most, n)
    last = row  # the value at (row, j), which follows the band's last row and then stays on row n
    for j, y in enumerate(b, 1):
        shift = j - most - 1
        held = where.get(y, 0)
        equal = (held >> shift if shift >= 0 else held << -shift) & full
        zero = ((((equal & rise) + rise) ^ rise) | equal | fall) & full
        up, down = fall | ~(zero | rise) & full, rise & zero
        if j + most <= n:
            row = j + most
            last += not zero & top
            if last - most + (n - m) > most:
                return most + 1
        else:
            at = 1 << (n - j + most)
            last += 1 if up & at else -1 if down & at else 0
            if last - (m - j) > most:
                return most + 1
        up = (up << 1 | 1) & full
        rise, fall = ((down << 1) & full | ~(zero | up) & full) >> 1 | top, (zero & up) >> 1
    return min(last, most + 1)


#: Distances that the diagonals are walked for before the columns take over.
NARROW = 12


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Word edit distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    d = _near_diagonals(a, b, min(most, NARROW))
    return d if d <= min(most, NARROW) or most <= NARROW else _bit_columns(a, b, most)


def least_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the distance: words that one side lacks."""
    both, counts_a = np.unique(a, return_counts=True)
    other, counts_b = np.unique(b, return_counts=True)
    _, at, bt = np.intersect1d(both, other, assume_unique=True, return_indices=True)
    shared = int(np.minimum(counts_a[at], counts_b[bt]).sum())
    return max(len(a), len(b)) - shared


def numbered(words: np.ndarray) -> np.ndarray:
    """Each word with the number of equal words before it, as one integer; what two texts share of them is what least_distance counts."""
    ordered = np.sort(words).astype(np.uint64)
    at = np.arange(len(ordered), dtype=np.uint64)
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return ordered << np.uint64(32) | (at - np.maximum.accumulate(np.where(fresh, at, np.uint64(0))))


def similar(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> bool:
    most = int((1 - threshold) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most or least_distance(a, b) > most:
        return False
    return edit_distance(a.tolist(), b.tolist(), most) <= most


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, sized: bool = False) -> DataFrame:
    """The pairs (a, b) of a written table whose alignment confirms the similarity; sized ones are known to be near in length. Words of b go
    to the tasks of a, with the words of those nodes only that are an a. A node in very many pairs is one row of texts, so Spark's skew join
    may split its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(whole(*x[:2]), whole(*x[2:]), threshold) for x in zip(*(batch.column(c).to_pylist() for c in ("la", "ha", "lb", "hb")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    if not sized:
        na, nb = (small_or_not(texts.select(F.col("node").alias(c), F.col("n_words").alias(f"n{c}"))) for c in "ab")
        near = F.abs(F.col("na") - F.col("nb")) <= (1 - threshold) * F.greatest("na", "nb") + 1e-9
        pairs = materialise(pairs.join(nb, "b").join(na, "a").where(near).select("a", "b"), "near")
    first = small_or_not(materialise(pairs.select("a").distinct(), "first"))
    left = texts.select(F.col("node").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha")).join(first, "a", "left_semi")
    right = texts.select(F.col("node").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    return right.join(small_or_not(pairs), "b").join(left, "a").select("a", "b", "la", "ha", "lb", "hb").mapInArrow(run, "a long, b long")


def roots(parents: DataFrame) -> DataFrame:
    """(node, label) of (node, label), each label smaller than its node: labels followed to their end, twice as far each round."""
    while True:
        above = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = parents.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved"))
        jumped = materialise(jumped, "roots")
        discard(parents)
        parents = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, for nodes with an edge. Each round hangs every node below its least
    neighbour, if that is smaller, and takes the links that are left over to the trees' roots, so later rounds
    only see links between trees."""
    left = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "left")
    labels = left.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    while not left.isEmpty():
        hung = roots(materialise(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "hung"))
        lower, upper = (hung.select(F.col("node").alias(c), F.col("label").alias(f"root_{c}")) for c in "ab")
        met = left.join(upper, "b").join(lower, "a", "left").withColumn("root_a", F.coalesce("root_a", "a")).where("root_a <> root_b")
        fresh = materialise(met.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "left")
        moved = labels.join(hung.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
        labels = materialise(moved.select("node", F.coalesce("root", "label").alias("label")).union(hung), "labels")
        discard(left)
        left = fresh
    return labels.union(labels.select("label", "label").distinct())


def _pairs_of_blocks(asked: pd.DataFrame, met: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The pairs between the nodes of two blocks of a bucket, or within several small buckets, that have different labels
    and that lengths, histograms and the words that one side lacks leave possible."""
    found = []
    if len(asked) and len(met):
        halved = [lower_half(w) for w in met["low"]]
        counts = np.frombuffer(b"".join(map(histogram, halved)), np.uint8).reshape(len(met), -1).astype(np.int16)
        keys, bands, nodes, labels, sizes, main = (met[c].to_numpy() for c in ("key", "band", "node", "label", "n_words", "main"))
        bags = [numbered(w) for w in halved]
        for key, band, node, label, size, low in asked[["key", "band", "node", "label", "n_words", "low"]].itertuples(index=False):
            most = ((1 - threshold) * np.maximum(sizes, size) + 1e-9).astype(np.int64)
            off = np.abs(sizes - size)
            some = np.flatnonzero((keys == key) & (bands == band) & (labels != label) & (off <= most) & (main | (nodes > node)))
            if not len(some):
                continue
            words = lower_half(low)
            apart = np.abs(counts[some] - np.frombuffer(histogram(words), np.uint8).astype(np.int16))
            single, double = apart[:, :HISTOGRAM].sum(axis=1), apart[:, HISTOGRAM:].sum(axis=1)
            some = some[(single + off[some] <= 2 * most[some]) & (double + off[some] <= 4 * most[some])]
            bag = numbered(words) if len(some) else None
            found += [(node, nodes[n]) for n in some.tolist() if max(size, sizes[n]) - len(np.intersect1d(bag, bags[n], assume_unique=True)) <= most[n]]
    return pd.DataFrame([(min(p), max(p)) for p in found], columns=["a", "b"], dtype="int64")


def mixed_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes of the buckets that hold several components: (key, node, label, main, held), main for nodes of the
    bucket's largest component, held the number of the bucket's nodes. Buckets with the same largest component are one bucket, named by it, if
    its pairs of an outside node and any other are no more than those of the buckets one by one."""
    held = buckets.select("key", "node").join(small_or_not(labels), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    held = materialise(held, "held")
    each = held.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = each.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("held"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    mixed = materialise(mixed.select("key", "held", F.col("main.label").alias("of"), (F.col("held") - F.col("main.n")).alias("out")), "several")
    apart = materialise(held.join(small_or_not(mixed.drop("out")), "key").select("key", "node", "label", "of", "held"), "apart")
    discard(held)
    once = materialise(apart.select("of", "node", "label").distinct(), "once")
    sums = once.groupBy("of").agg(F.count(F.lit(1)).alias("held"), F.sum((F.col("label") != F.col("of")).cast("long")).alias("out"))
    by_one = mixed.groupBy("of").agg(F.sum(F.col("held") * F.col("out")).alias("most"))
    fewer = small_or_not(materialise(sums.join(by_one, "of").where("held * out <= most").select("of", "held"), "fewer"))
    main = (F.col("label") == F.col("of")).alias("main")
    together = once.join(fewer, "of").select(F.col("of").alias("key"), "node", "label", main, "held")
    return together.union(apart.join(fewer, "of", "left_anti").select("key", "node", "label", main, "held"))


def residual_links(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links across components, from the buckets that hold several. Nodes of a bucket of more than a block are told apart by bands of length first; those
    outside a bucket's main component meet the nodes of their own and the two neighbouring bands, block by block, so a
    task holds two blocks whatever the size of the bucket. Small groups are taken together, about four blocks at a time."""
    band = F.floor(F.log(F.greatest("n_words", F.lit(1)) + F.lit(1e-9)) / F.log(F.lit(1 / threshold))).cast("int")
    lengths = small_or_not(texts.select("node", "n_words"))
    rows = materialise(mixed.join(lengths, "node").withColumn("band", F.when(F.col("held") > BLOCK, band).otherwise(0)), "banded")
    each = rows.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("main")).cast("long")).alias("out"))
    each = each.groupBy("key").agg(F.collect_list(F.struct("band", "n", "out")).alias("bands"))  # bands grow with the log of the longest text

    def around(bands, b):
        return F.filter(bands, lambda y: F.abs(y["band"] - b) <= 1)

    def outside(b):
        return F.aggregate(around("bands", b), F.lit(0).cast("long"), lambda total, y: total + y["out"])

    sums = F.transform("bands", lambda x: F.struct(x["band"].alias("band"), x["n"].alias("n"), outside(x["band"]).alias("outside")))
    sizes = materialise(each.select("key", F.filter(sums, lambda x: x["outside"] > 0).alias("bands")), "bands")
    packs = max(1, (sizes.agg(F.sum(F.size("bands"))).first()[0] or 0) * 4 // BLOCK)
    placed = materialise(rows.join(sizes, "key").withColumn("bands", around("bands", F.col("band"))), "placed")
    discard(rows)

    def blocks(of: str):
        return F.ceil(F.col(of) / BLOCK).cast("int")

    def in_bands(some: DataFrame, bands) -> DataFrame:
        small = F.greatest("n", "outside") <= BLOCK
        spread = some.withColumn("in", F.explode(bands)).drop("band", "bands").select("*", "in.*").drop("in")
        return spread.withColumn("small", small).withColumn("pack", F.when(small, F.pmod(F.xxhash64("key", "band"), F.lit(packs))).otherwise(F.xxhash64("key", "band")))

    asked = materialise(in_bands(placed.where("NOT main"), F.col("bands")), "asking")
    met = materialise(in_bands(placed, F.filter("bands", lambda x: x["band"] == F.col("band"))), "meeting")
    asked, met = (texts.select("node", "low").join(small_or_not(x), "node") for x in (asked, met))
    asked = asked.withColumn("i", F.pmod(F.xxhash64("node"), blocks("outside"))).withColumn("j", F.explode(F.sequence(F.lit(0), blocks("n") - 1)))
    met = met.withColumn("i", F.explode(F.sequence(F.lit(0), blocks("outside") - 1))).withColumn("j", F.pmod(F.xxhash64("node"), blocks("n")))
    names = ("key", "band", "node", "label", "main", "n_words", "low")
    places = [F.col(c).cast("long").alias(c) for c in ("pack", "i", "j")]  # rows of an int and a long that are equal go to different tasks
    asked, met = (x.select("small", *places, *[F.col(c).alias(c) for c in names]).groupBy("small", "pack", "i", "j") for x in (asked, met))
    pairs = asked.cogroup(met).applyInPandas(lambda a, b: _pairs_of_blocks(a, b, threshold), "a long, b long").distinct()
    pairs = materialise(pairs, "possible")
    asked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    return verify(pairs, texts.join(small_or_not(asked), "node", "left_semi"), threshold, sized=True)


def fetch_words(docs: DataFrame, texts: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """(node, n_words, low, high) of some nodes, one row each; only their texts are taken to words."""
    needed = materialise(texts.join(nodes.distinct(), "node", "left_semi").select("node", F.col("digest").alias("of")), "needed")
    one = small_or_not(needed)
    rows = named_texts(docs, text)
    found = rows.join(one, (rows["doc_id"] == one["node"]) & (rows["digest"] == one["of"]))
    words = materialise(word_rows(found.select("node", "text")), "words")
    return words if words.count() == needed.count() else materialise(words.dropDuplicates(["node"]), "words")


@settled("near-dedup")
def near_duplicates(docs: DataFrame, text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept, text_sha256) of every row: the smallest doc_id of its class, and whether that is the row's own."""
    rows = materialise(sketch_rows(docs, text), "sketches")
    ids = materialise(rows.select("doc_id", "digest"), "ids")
    named = materialise(ids.groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    texts = named.where("node IS NOT NULL").groupBy("node").agg(F.min("digest").alias("digest"))
    texts = materialise(texts, "texts")
    one = small_or_not(texts)
    named_rows = rows.join(one, (rows["doc_id"] == one["node"]) & (rows["digest"] == one["digest"])).drop(one["digest"])
    single = named_rows.select("node", "twos", "threes").where("size(twos) + size(threes) > 0").dropDuplicates(["node"])
    short = materialise(single, "short")
    rare = materialise(rare_keys(short), "rare")
    discard(short)
    keyed = named_rows.select("node", F.explode("buckets").alias("key")).union(rare).repartition("key")
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    buckets = materialise(keyed.join(shared, "key").select("key", "node", "a").distinct(), "buckets")
    discard(rows)  # keys and runs are most of what is written
    pairs = materialise(buckets.where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    words = fetch_words(docs, texts, pairs.select(F.explode(F.array("a", "b")).alias("node")), text)
    edges = materialise(verify(pairs, words, threshold), "edges")
    labels = materialise(components(edges), "components")
    mixed = materialise(mixed_buckets(buckets, labels), "mixed")
    discard(buckets)
    more = materialise(residual_links(mixed, words, threshold), "links")
    first = named.join(labels, "node", "left").select("digest", "node", F.coalesce("label", "node").alias("class_id"))
    ends = (labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in "ab")
    lifted = more.join(next(ends), "a", "left").join(next(ends), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(lifted.distinct()).select(F.col("node").alias("class_id"), "label")  # components of components
    known = first.join(joined, "class_id", "left").select("digest", F.coalesce("label", "class_id").alias("class_id"))
    return ids.join(known, "digest").select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
