"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The pieces come from a given model file (its path is a parameter). A file of merge ranks has no probabilities: there
a piece of rank r gets the Zipf score -ln(1 + r) - ln(sum of 1 / (1 + r)). A space is the marker U+2581, and a text begins with one
more; a character that no piece covers costs ten more than the worst piece and is written as its UTF-8 bytes. Among
segmentations of equal score, the piece that begins earlier wins.

No piece runs from a word into the next marker or over a line end (checked at load; else a text is one segment), so a
text's best path is the sequence of its segments' best paths. All new distinct segments of an Arrow batch go through
the trie together, one numpy step per position and depth; known segments are looked up.

Decoding joins the pieces' bytes, turns markers into spaces and drops the first one; a literal U+2581 of the text was
written as bytes, so decode(encode(x)) == x for every x.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are encoded each; ids
outside of the model decode to nothing; invalid UTF-8 from byte pieces becomes U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import body, worker_cache

MARK = "▁"
MARK_BYTES = MARK.encode()
UNKNOWN_COST = 10.0
CACHE_SEGMENTS = 200_000
#: Segments, and table cells (segments times the longest one's bytes), that go through the trie together; one segment always may.
CHUNK = 4096
CELLS = 1 << 19


@dataclass(frozen=True)
class Trie:
    """base[s] + byte is the child of state s if check[] there is s; value[] is a state's piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(pieces: dict[bytes, int]) -> Trie:
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for piece, i in pieces.items():
        node = 0
        for byte in piece:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][byte]
        ends[node] = i
    room = 4 * len(children) + 4096
    base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    taken = bytearray(room)
    taken[0] = 1
    value[0] = ends[0]
    free, top, queue = 256, 256, [(0, 0)]  # no slot below, so that every byte can reach the first free one
    for node, state in queue:  # breadth first; the list grows while it is read
        bytes_ = sorted(children[node])
        if not bytes_:
            continue
        while taken[free]:
            free += 1
        first = free if len(bytes_) == 1 else max(free, top - 1024)  # the dense part holds single children only
        at = max(1, first - bytes_[0])
        while any(taken[at + b] for b in bytes_):
            at += 1
        base[state] = at
        top = max(top, at + bytes_[-1])
        for b in bytes_:
            taken[at + b] = 1
            check[at + b] = state
            value[at + b] = ends[children[node][b]]
            queue.append((children[node][b], at + b))
    last = int(np.flatnonzero(np.frombuffer(taken, np.uint8)).max()) + 257
    return Trie(base[:last].copy(), check[:last].copy(), value[:last].copy())


@dataclass(frozen=True)
class Pieces:
    """A loaded vocabulary: the trie, log scores by id, byte ids by byte, and each id's bytes for decoding."""

    name: str
    trie: Trie
    scores: np.ndarray
    byte_ids: np.ndarray
    surface: tuple[bytes, ...]
    pattern: str
    ready: dict = field(default_factory=dict, compare=False, hash=False)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """Read the pieces of a SentencePiece model file on the driver; a vocabulary is of fixed size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids, surface, pieces = np.full(256, -1, np.int32), [b""] * size, {}
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[piece.encode()] = i
            surface[i] = piece.replace(MARK, " ").encode()
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte pieces to fall back on")
    scores = np.array([model.get_score(i) for i in range(size)], dtype=np.float64)
    used = np.array(sorted(pieces.values()))
    if np.array_equal(scores[used], np.round(scores[used])):  # merge ranks
        ranks = -scores[used]
        scores[used] = -np.log1p(ranks) - np.log((1 / (1 + ranks)).sum())
    scores = np.round(scores * 2**20) / 2**20  # so that sums are exact and equal scores are equal in any order
    parted = not any("\n" in (t := p.decode()) or MARK in t.lstrip(MARK) for p in pieces)
    return Pieces(path, build_trie(pieces), scores, byte_ids, tuple(surface), r" *[^ \n▁]+| +|\n|▁" if parted else r"[^▁]+|▁")


def viterbi(segments: list[bytes], model: Pieces) -> list[np.ndarray]:
    """The ids of each segment (markers already in place)."""
    order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(segments)
    while order:  # the longest first, so that a very long segment doesn't widen the rows of thousands of others
        count = max(1, min(CHUNK, CELLS // (len(segments[order[-1]]) + 1)))
        order, some = order[:-count], order[-count:]
        for i, ids in zip(some, _paths([segments[i] for i in some], model), strict=True):
            out[i] = ids
    return out


def _paths(segments: list[bytes], model: Pieces) -> list[np.ndarray]:
    trie, scores = model.trie, model.scores
    lengths = np.array([len(s) for s in segments])
    n, width = len(segments), int(lengths.max())
    text = np.zeros((n, width + 1), np.uint8)
    flat = np.frombuffer(b"".join(segments), np.uint8)
    rows = np.repeat(np.arange(n), lengths)
    text[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    came = np.zeros((n, width + 1), np.int32)
    piece = np.full((n, width + 1), -1, np.int32)
    unknown = scores[trie.value[trie.value >= 0]].min() - UNKNOWN_COST
    lead = text[:, :-1]
    sizes = 1 + (lead >= 0xC0).astype(np.int8) + (lead >= 0xE0) + (lead >= 0xF0)
    for s in range(width):
        rows = np.flatnonzero((lengths > s) & (best[:, s] > -np.inf))
        if not len(rows):
            continue
        from_, one = best[rows, s], s + sizes[rows, s].astype(np.int64)
        single = np.zeros(len(rows), bool)
        live, state, depth = np.arange(len(rows)), np.zeros(len(rows), np.int32), s
        while len(live):
            nxt = trie.base[state] + text[rows[live], depth]
            good = (trie.check[nxt] == state) & (depth < lengths[rows[live]])
            live, state = live[good], nxt[good]
            depth += 1
            ids = trie.value[state]
            ends = ids >= 0
            if ends.any():
                hit, ids = live[ends], ids[ends]
                total = from_[hit] + scores[ids]
                better = total > best[rows[hit], depth]
                hit, ids = hit[better], ids[better]
                best[rows[hit], depth], came[rows[hit], depth], piece[rows[hit], depth] = total[better], s, ids
                single[live[ends]] |= one[live[ends]] == depth
        lost = np.flatnonzero(~single)
        total = from_[lost] + unknown
        better = total > best[rows[lost], one[lost]]
        lost = lost[better]
        best[rows[lost], one[lost]], came[rows[lost], one[lost]], piece[rows[lost], one[lost]] = total[better], s, -1
    # Walk all paths back together.
    where, active, steps = lengths.copy(), np.arange(n), []
    while len(active):
        end = where[active]
        start = came[active, end]
        steps.append((active, start, end, piece[active, end]))
        where[active] = start
        active = active[start > 0]
    found: list[list[np.ndarray | int]] = [[] for _ in range(n)]
    for rows, start, end, ids in steps:
        for r, a, b, i in zip(rows.tolist(), start.tolist(), end.tolist(), ids.tolist(), strict=True):
            if i >= 0:
                found[r].append(i)
            else:
                found[r].extend(model.byte_ids[text[r, a:b][::-1]].tolist())
    return [np.array(f[::-1], np.int32) for f in found]


class Encoder:
    """Known segments by number, their ids one after another."""

    def __init__(self, model: Pieces) -> None:
        self.model, self.find = model, re.compile(model.pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, segments: list[str]) -> None:
        literal = self.model.byte_ids[np.frombuffer(MARK_BYTES, np.uint8)]
        paths = viterbi([s.replace(" ", MARK).encode() if s != MARK else b"" for s in segments], self.model) if segments else []
        paths = [literal if s == MARK else p for s, p in zip(segments, paths, strict=True)]
        self.number.update(zip(segments, range(len(self.number), len(self.number) + len(segments)), strict=True))
        sizes = np.array([len(p) for p in paths], np.int64)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.size = np.concatenate([self.ids, *paths]), np.concatenate([self.size, sizes])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.find(" " + t) if t else [] for t in texts]
        if len(self.number) > CACHE_SEGMENTS:
            self._clear()
        new = {s for p in parts for s in p if s not in self.number}
        if new:
            self._learn(sorted(new))
        out = []
        for p in parts:
            which = np.fromiter(map(self.number.__getitem__, p), np.int64, len(p))
            size = self.size[which]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.ids[np.repeat(self.begin[which] - (ends - size), size) + np.arange(total)])
        return out


def decode_ids(ids: list[int] | np.ndarray, model: Pieces) -> str:
    surface, size = model.surface, len(model.surface)
    raw = b"".join([surface[i] for i in ids if 0 <= i < size]) if isinstance(ids, list) else b"".join(map(surface.__getitem__, ids.tolist()))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


#: Texts encoded at once within an Arrow batch.
TEXTS = 64


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, text_sha256, ids) of every row, and with `decoded` the text that the ids decode to."""
    model = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(("encoder", model.name), lambda: Encoder(model))
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                ids = encoder.encode(part.column("text").to_pylist())
                columns = [part.column("doc_id"), part.column("text_sha256"), _lists(ids)]
                if decoded:
                    columns.append(pa.array([decode_ids(x, model) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_sha256", "ids", "decoded"][: len(columns)])

    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(body(text).cast("binary"), 256).alias("text_sha256"), body(text).alias("text"))
    return inputs.mapInArrow(run, "doc_id long, text_sha256 string, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with id lists."""
    model = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids([i for i in x or () if i is not None], model) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(encoded: DataFrame) -> DataFrame:
    """encode(decoded=True) with the decoded text as its digest and whether it is the document again."""
    back = F.sha2(F.col("decoded").cast("binary"), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", back.alias("decoded_sha256"), (back == F.col("text_sha256")).alias("same"))
