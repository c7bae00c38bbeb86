from __future__ import annotations

import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import spiece as x
from foliant.llm.queries import PIECES

from .cases import documents

if not os.path.exists(PIECES):
    pytest.skip("no vocabulary file here", allow_module_level=True)


@pytest.fixture(scope="module")
def model():
    return x.load(PIECES)


def best_score(text: str, model: x.Pieces) -> float:
    """The plain dynamic programme over a dictionary of pieces."""
    raw = text.replace(" ", x.MARK).encode()
    scores = {s.decode("utf-8", "replace").replace(" ", x.MARK).encode(): model.scores[i] for i, s in enumerate(model.surface) if s and i not in set(model.byte_ids)}
    unknown = min(scores.values()) - x.UNKNOWN_COST
    best = [0.0] + [float("-inf")] * len(raw)
    for s in range(len(raw)):
        if best[s] == float("-inf") or raw[s] & 0xC0 == 0x80:
            continue
        one = s + 1
        while one < len(raw) and raw[one] & 0xC0 == 0x80:
            one += 1
        for e in range(s + 1, min(len(raw), s + 64) + 1):
            if raw[s:e] in scores:
                best[e] = max(best[e], best[s] + scores[raw[s:e]])
        if raw[s:one] not in scores:
            best[one] = max(best[one], best[s] + unknown)
    return best[-1]


def path_score(ids, model) -> float:
    bytes_, unknown = set(model.byte_ids.tolist()), model.scores[model.trie.value[model.trie.value >= 0]].min() - x.UNKNOWN_COST
    total, run = 0.0, b""
    for i in ids:
        if i in bytes_:
            run += model.surface[i]
            continue
        total += model.scores[i]
    return total + len(run.decode()) * unknown


@pytest.mark.parametrize("text", ["the house", "Zürich – naïve", "a\nb  c", "日本語 text", "🙂🙂 ok", "   ", "internationalisation of words"])
def test_paths_are_the_best(model, text):
    ids = x.Encoder(model).encode([text])[0]
    assert path_score(ids.tolist(), model) == pytest.approx(best_score(" " + text, model), abs=1e-9)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" ▁\nabé🙂\t　", max_size=40))
def test_round_trip(text):
    model = x.load(PIECES)
    assert x.decode_ids(x.Encoder(model).encode([text])[0], model) == text


def test_very_long_segment_among_many(model):
    """A table of all segments by the longest one's bytes would not fit in memory."""
    text = "x" * 200_000 + " " + " ".join(f"word{i}" for i in range(5000))
    assert x.decode_ids(x.Encoder(model).encode([text])[0], model) == text


def test_trie_holds_the_pieces_alone(model):
    trie = model.trie

    def find(word: bytes) -> int:
        state = 0
        for byte in word:
            state, before = int(trie.base[state]) + byte, state
            if trie.check[state] != before:
                return -1
        return int(trie.value[state])

    held = {s.replace(b" ", x.MARK_BYTES): i for i, s in enumerate(model.surface) if s and i not in set(model.byte_ids.tolist())}
    assert all(find(s) == i for s, i in held.items())
    assert all(find(s[:-1] + b"\xff") == -1 for s in held)


def test_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "word " * 60_000), (4, "a▁b"), (4, "a▁b"), (None, "x y"), (6, "tab\tand\r\nline\n\n")]
    got = x.digest(x.encode(documents(spark, rows), PIECES, decoded=True)).collect()
    assert len(got) == len(rows) and all(r["same"] for r in got)
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in got) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in got}[1] == 0
    back = x.decode(spark.createDataFrame([(1, None), (2, []), (3, [10**6, -1, None])], "doc_id long, ids array<int>"), PIECES).collect()
    assert [r["text"] for r in sorted(back)] == ["", "", ""]
    assert x.encode(documents(spark, []), PIECES).count() == 0


def test_tables_of_paths_stay_small(monkeypatch):
    """Many long segments go through the trie in parts of at most half a million cells."""
    from foliant.llm import spiece

    cells = []
    monkeypatch.setattr(spiece, "_paths", lambda some, model: cells.append(len(some) * (max(map(len, some)) + 1)) or [None] * len(some))
    assert len(spiece.viterbi([b"x" * 300] * 5000, None)) == 5000 and max(cells) <= 1 << 19
