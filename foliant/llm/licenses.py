"""License scans by template-markup matching.

A template is a license's wording in which `<<beginOptional>>...<<endOptional>>` may be left out and
`<<var;name=holder;words=1-20>>` stands for so many words of any kind; all other words are mandatory. Templates compile to
one automaton over tokens: a word leads from state to state, optional regions are stepped over, a replaceable one is a
row of states that any word passes. From each word that can begin a template, the automaton runs until it stops; a text
holds a license where its mandatory wording stands exactly, word by word. Sets of states are numbered as they are met, so
a run costs one lookup a word, and no run is longer than the longest template.

The base phrases are templates of mandatory words alone. All their places count; of a license's own places, those that
begin first are kept, the longest of a start, and none that overlaps one before.

Scanning is one narrow stage over every row and whole texts. Defined results: null and empty texts have no words, no
places and score 0; texts of any length are scanned whole, in time proportional to their words; repeated rows are scanned
each; an empty table gives no rows; other columns play no part. Ties of start go in the order of the labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import body, byte_words, worker_cache

# Fixed values of the contract.
PHRASES = (("mit", "MIT License"), ("apache", "Apache License"), ("gpl", "General Public License"))

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;words=1-20>> BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_COPYRIGHT = "<<beginOptional>>Copyright <<var;name=copyright;words=0-20>><<endOptional>> <<beginOptional>>All rights reserved<<endOptional>>"

# Public license wordings, as templates.
TEMPLATES = (
    ("mit", f"""<<beginOptional>>The<<endOptional>> <<beginOptional>>MIT License<<endOptional>> <<beginOptional>>MIT<<endOptional>> {_COPYRIGHT}
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
        substantial portions of the Software. {_AS_IS}"""),
    ("mit", "<<beginOptional>>is<<endOptional>> <<beginOptional>>Released<<endOptional>> <<beginOptional>>Licensed<<endOptional>> <<beginOptional>>distributed<<endOptional>> under the MIT License"),
    ("mit", "SPDX License Identifier: MIT"),
    ("bsd", f"""{_COPYRIGHT} Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=organisation;words=1-20>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.<<endOptional>>
        THIS SOFTWARE IS PROVIDED BY <<var;name=holder;words=1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("bsd", "under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>2 Clause<<endOptional>> <<beginOptional>>3 Clause<<endOptional>> BSD License"),
    ("isc", f"""<<beginOptional>>ISC License<<endOptional>> {_COPYRIGHT} Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("apache", """Licensed under the Apache License, <<beginOptional>>Version 2.0<<endOptional>> <<beginOptional>>(the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at <<var;name=address;words=1-12>> Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.<<endOptional>>"""),
    ("apache", "SPDX License Identifier: Apache 2.0"),
    ("gpl", """<<beginOptional>>This<<endOptional>> <<beginOptional>>work<<endOptional>> <<beginOptional>>is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU
        <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License<<beginOptional>>, version <<var;name=version;words=1-2>><<endOptional>>"""),
    ("gpl", """<<var;name=program;words=1-6>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU
        <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License as published by the Free Software Foundation"""),
    ("gpl", "SPDX License Identifier: <<beginOptional>>L<<endOptional>> GPL <<var;name=version;words=1-3>>"),
    ("cc", """<<beginOptional>>This<<endOptional>> <<beginOptional>>work<<endOptional>> <<beginOptional>>is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
        Creative Commons Attribution <<var;name=kind;words=0-4>> <<beginOptional>>International<<endOptional>> License"""),
    ("cc", "licensed under CC BY <<beginOptional>>NC<<endOptional>> <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> <<var;name=version;words=2-2>>"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, <<beginOptional>>v. 2.0<<endOptional>>"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
        the use of this software."""),
)

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^<>]*)>>")
#: In place of a word's number: a step that any word takes.
_ANY = -1
#: Sets of states that a worker keeps numbered at most; beyond, it begins anew.
_SETS = 50_000


def _parts(markup: str) -> Iterator[tuple[str, str]]:
    """("word", word), ("beginOptional", ""), ("endOptional", "") and ("var;...", "") in their order."""
    at = 0
    for m in [*_MARK.finditer(markup), None]:
        yield from (("word", w.decode()) for w in byte_words(markup[at : m.start() if m else None].encode()))
        if m:
            yield m[1], ""
            at = m.end()


@dataclass
class Automaton:
    """The union of all templates: step[state] has (word or _ANY, next state), skip[state] the states that cost no word."""

    words: dict[bytes, int] = field(default_factory=dict)
    step: list[tuple[int, int] | None] = field(default_factory=lambda: [None])
    skip: list[list[int]] = field(default_factory=lambda: [[]])
    ends: dict[int, tuple[str, bool]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.sets: dict[frozenset, int] = {}
        self.known: list[tuple[frozenset, tuple]] = []
        self.moves: dict[tuple[int, int], int] = {}

    def _state(self) -> int:
        self.step.append(None)
        self.skip.append([])
        return len(self.step) - 1

    def add(self, label: str, markup: str, base: bool) -> None:
        at, begun, mandatory = self._state(), [], 0
        self.skip[0].append(at)
        for kind, word in _parts(markup):
            if kind == "word":
                self.step[at] = (self.words.setdefault(word.encode(), len(self.words) + 1), nxt := self._state())
                mandatory += not begun
                at = nxt
            elif kind == "beginOptional":
                begun.append(at)
                inner = self._state()
                self.skip[at].append(inner)
                at = inner
            elif kind == "endOptional":
                after = self._state()
                self.skip[at].append(after)
                self.skip[begun.pop()].append(after)
                at = after
            else:
                least, most = map(int, re.search(r"words=(\d+)-(\d+)", kind).groups())
                after = self._state()
                for n in range(most):
                    if n >= least:
                        self.skip[at].append(after)
                    self.step[at] = (_ANY, nxt := self._state())
                    at = nxt
                self.skip[at].append(after)
                at = after
        if begun or not mandatory:
            raise ValueError(f"a template of {label} leaves a region open or has no mandatory word")
        self.ends[at] = (label, base)

    def number(self, states: set[int]) -> int:
        """The number of a set of states with all that can be reached without a word; -1 for the empty set."""
        ahead, reached = list(states), set(states)
        while ahead:
            for s in self.skip[ahead.pop()]:
                if s not in reached:
                    reached.add(s)
                    ahead.append(s)
        key = frozenset(reached)
        if not key:
            return -1
        if key not in self.sets:
            self.sets[key] = len(self.known)
            self.known.append((key, tuple(sorted({self.ends[s] for s in key if s in self.ends}))))
        return self.sets[key]

    def move(self, at: int, word: int) -> int:
        got = self.moves.get((at, word))
        if got is None:
            steps = [self.step[s] for s in self.known[at][0] if self.step[s]]
            got = self.moves[at, word] = self.number({n for w, n in steps if w in (word, _ANY)})
        return got

    def ready(self) -> Automaton:
        """With the words, and pairs of words, that a template can begin with."""
        if len(self.known) > _SETS:
            self.__post_init__()
        first = self.number({0})
        self.begins = np.zeros(len(self.words) + 1, dtype=bool)
        self.follows = np.zeros((len(self.words) + 1, len(self.words) + 1), dtype=bool)
        for w in range(len(self.words) + 1):
            second = self.move(first, w)
            self.begins[w] = second >= 0
            if second >= 0:
                steps = [self.step[s] for s in self.known[second][0] if self.step[s]]
                self.follows[w] = bool(self.known[second][1]) or any(x == _ANY for x, _ in steps)
                self.follows[w, [x for x, _ in steps if x != _ANY]] = True
        return self

    def places(self, found: list[bytes]) -> list[tuple[int, int, str, bool]]:
        """(start, end, label, base) of a text's words, as the module says, in order."""
        if len(self.known) > _SETS:
            self.ready()
        ids = np.fromiter((self.words.get(w, 0) for w in found), dtype=np.int32, count=len(found))
        starts = np.flatnonzero(self.begins[ids])
        starts = starts[(starts + 1 >= len(ids)) | self.follows[ids[starts], ids[np.minimum(starts + 1, len(ids) - 1)]]]
        if not len(starts):
            return []
        out, busy, line = [], {}, ids.tolist()
        first = self.sets[frozenset(self.known[0][0])]
        for start in starts.tolist():
            at, pos, ends = first, start, {}
            while pos < len(line):
                at = self.move(at, line[pos])
                if at < 0:
                    break
                pos += 1
                for end in self.known[at][1]:
                    ends[end] = pos
            for (label, base), end in sorted(ends.items()):
                if base or start >= busy.get(label, 0):
                    out.append((start, end, label, base))
                    if not base:
                        busy[label] = end
        return out


def compiled(templates=TEMPLATES, phrases=PHRASES) -> Automaton:
    a = Automaton()
    for label, phrase in phrases:
        a.add(label, phrase, True)
    for label, markup in templates:
        a.add(label, markup, False)
    return a.ready()


def find_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words and places, an array of (start, end, label, base): word positions from 0, ends exclusive; base for
    the places of phrases."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("base", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = worker_cache(("licenses", templates, phrases), lambda: compiled(templates, phrases))
        for b in batches:
            counts, places = [], []
            for data in b.column("data"):
                found = byte_words(data.as_py())
                counts.append(len(found))
                places.append([dict(zip(("start", "end", "label", "base"), p, strict=True)) for p in automaton.places(found)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, pa.list_(place))], ["doc_id", "n_words", "places"])

    rows = docs.select("doc_id", body().cast("binary").alias("data"))
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, places array<struct<start:long,end:long,label:string,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns. score is the share of a text's words that stand in a place of either kind."""
    base = F.filter("places", lambda p: p["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    last = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def cover(a, p):  # places come by their start
        upto = F.greatest(a["upto"], p["end"])
        return F.struct(upto.alias("upto"), (a["n"] + upto - F.greatest(F.least(a["upto"], upto), p["start"])).alias("n"))

    covered = F.aggregate("places", last, lambda a, p: F.when(p["end"] > a["upto"], cover(a, p)).otherwise(a))["n"]
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )
