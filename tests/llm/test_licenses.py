from __future__ import annotations

import random
import re
import time

import pytest

from foliant.llm import licenses as x
from foliant.llm.queries import op13_licenses

from .cases import by_id, documents

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def as_regex(markup: str) -> re.Pattern:
    """A template as a pattern over words that each end in a blank."""
    out = []
    for part in re.split(r"(<<[^<>]*>>)", markup):
        if part == "<<beginOptional>>":
            out.append("(?:")
        elif part == "<<endOptional>>":
            out.append(")?")
        elif part.startswith("<<"):
            out.append(r"(?:[^ ]+ ){%s,%s}" % re.search(r"words=(\d+)-(\d+)", part).groups())
        else:
            out += [w + " " for w in words_of(part)]
    return re.compile("".join(out))


def brute(words: list[str], templates, phrases):
    """Every start and end tried with a pattern, then the rules on overlaps."""
    found = []
    for base, group in ((True, phrases), (False, templates)):
        best: dict = {}
        for label, markup in group:
            pattern = as_regex(markup)
            for s in range(len(words)):
                for e in range(len(words), s, -1):
                    if pattern.fullmatch("".join(w + " " for w in words[s:e])):
                        best[label, s] = max(e, best.get((label, s), 0))
                        break
        busy: dict = {}
        for (label, s), e in sorted(best.items(), key=lambda b: (b[0][1], b[0][0])):
            if base or s >= busy.get(label, 0):
                found.append((s, e, label, base))
                busy[label] = e
    return sorted(found)


TOY = (
    ("one", "a b <<beginOptional>>c <<beginOptional>>d<<endOptional>><<endOptional>> e"),
    ("one", "<<beginOptional>>x<<endOptional>> a <<var;name=v;words=0-2>> f"),
    ("two", "b <<var;name=v;words=1-3>> b"),
    ("three", "<<var;name=v;words=1-2>> e f"),
)


def test_automaton_against_patterns():
    rng, a = random.Random(3), x.compiled(TOY, (("base", "A B"), ("other", "b a")))
    for _ in range(600):
        words = [rng.choice("abcdefx") for _ in range(rng.randint(0, 14))]
        assert sorted(a.places([w.encode() for w in words])) == brute(words, TOY, (("base", "A B"), ("other", "b a"))), words


def test_templates_of_licenses():
    a = x.compiled()
    labels = lambda text: sorted({p[2] for p in a.places([w.encode() for w in words_of(text)]) if not p[3]})
    mit = re.sub(r"<<var[^<>]*>>", "Jane Roe and others", re.sub(r"<<(begin|end)Optional>>", "", x.TEMPLATES[0][1]))
    assert labels(mit) == ["mit"]
    assert labels(mit.replace("free of charge", "free of charges")) == []  # mandatory wording
    assert labels(re.sub(r"Copyright [^<]*?Permission is", "Copyright (c) 2019 The Authors. Permission is", mit)) == ["mit"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc"]
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache"]
    assert labels("We talked about licenses, permission and copyright at length.") == []


def test_bad_templates():
    for markup in ("<<beginOptional>>a<<endOptional>>", "a <<beginOptional>>b", "<<var;name=x;words=1-2>>"):
        with pytest.raises(ValueError):
            x.compiled((("bad", markup),), ())


def test_digest_and_odd_rows(spark):
    rows = [
        (1, "Under the MIT License, the mit  license; and the Apache License."), (2, None), (3, ""), (4, "word " * 300_000 + "General Public License"), (4, "mit license"),
        (None, "Licensed under CC BY-NC 4.0."), (6, "MIT-License MITLicense mit\nlicense"), (7, "mit"), (8, "mit license mit license"),
    ]
    found = x.digest(x.find_licenses(documents(spark, rows))).collect()
    assert len(found) == len(rows)
    got = {(r["doc_id"], r["n_words"]): r for r in found}
    assert tuple(got[1, 11][2:]) == (3, 2, 9, "apache,mit", "apache,mit", 8 / 11)  # "under the" belongs to a notice
    assert tuple(got[2, 0][2:]) == tuple(got[3, 0][2:]) == (0, None, None, "", "", 0.0)
    assert got[4, 300_003]["first_word"] == 300_000 and got[4, 300_003]["base_labels"] == "gpl"
    assert tuple(got[None, 7][2:]) == (0, None, None, "", "cc", 1.0)
    assert (got[6, 5]["n_base"], got[6, 5]["first_word"], got[6, 5]["last_word"]) == (2, 0, 3)
    assert got[7, 1]["n_base"] == 0 and got[8, 4]["n_base"] == 2 and got[8, 4]["score"] == 1.0
    assert x.digest(x.find_licenses(documents(spark, rows).limit(0))).count() == 0


def test_time_grows_with_the_words():
    a = x.compiled()
    took = []
    for n in (20_000, 80_000):
        words = [w.encode() for w in words_of("copyright " * n)]
        began = time.perf_counter()
        a.places(words)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.02)


def test_query_against_brute_force(spark, small):
    got = by_id(op13_licenses(spark, small))
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        words, g = words_of(r["text"]), got[r["doc_id"]]
        starts = [(i, label) for label, phrase in x.PHRASES for i in range(len(words)) if words[i : i + len(p := words_of(phrase))] == p]
        assert g["n_words"] == len(words) and g["n_base"] == len(starts) and g["base_labels"] == ",".join(sorted({s[1] for s in starts}))
        assert (g["first_word"], g["last_word"]) == ((min(starts)[0], max(starts)[0]) if starts else (None, None))
        joined = "".join(w + " " for w in words)
        own = {label for label, markup in x.TEMPLATES if any(m.start() == 0 or joined[m.start() - 1] == " " for m in as_regex(markup).finditer(joined))}
        assert g["labels"] == ",".join(sorted(own | {s[1] for s in starts})), r["doc_id"]
