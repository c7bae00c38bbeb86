from __future__ import annotations

import random
import re

from foliant.llm import decontam as x

from .cases import clashing, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, width=10):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            v = words(it)
            if item is None or not v:
                continue
            for s in range(max(1, len(v) - width + 1)):
                run = v[s : s + width]
                for at in range(len(w) - len(run) + 1):
                    if w[at : at + len(run)] == run:
                        hit.update(range(at, at + len(run)))
                        found.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for r in df.collect()), key=repr)


def fixture():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "naïve", "über"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(9, 16)))) for k in range(8)]
    items += [(20, "Short one"), (21, items[0][1]), (22, None), (23, ""), (24, "?!"), (None, "w1 w2 w3"), (25, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    rows = []
    for i in range(40):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = (items[i % 8][1]).split()
        rows.append((i, ", ".join(text)))
    rows += [(50, None), (51, ""), (52, "w1 " * 3000), (53, "SHORT-one here; short\none"), (53, "another text of row 53 w1 w2"), (54, items[1][1].upper()), (54, items[1][1].upper()), (None, items[2][1])]
    return rows, items


def test_against_brute_force(spark):
    rows, items = fixture()
    tests = clashing(spark.createDataFrame(items, "item_id long, text string"))
    assert got(x.decontaminate(documents(spark, rows), tests)) == brute(rows, items)


def test_shuffled_and_broadcast_sides_agree(spark, monkeypatch):
    rows, items = fixture()
    tests = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(x, "small_or_not", lambda df: df)
    assert got(x.decontaminate(documents(spark, rows), tests)) == brute(rows, items)


def test_proximity(spark):
    item = "zero one two three four five six seven eight nine"
    far = item.replace("five", "five" + " x" * 9)  # half of the terms have left their places
    docs = documents(spark, [(1, item), (2, item.replace("one two", "one extra two")), (3, "seven, seven"), (4, item.replace("seven", "other")), (5, far)])
    found = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in x.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {1: (10, 0), 2: (0, 1), 3: (0, 0), 4: (0, 1), 5: (0, 0)}


def test_terms_that_the_corpus_lacks(spark):
    docs = documents(spark, [(1, "zero one two three four five six seven eight other")])
    item = "zero one two three four five six seven eight nine"
    assert [(r["n_hit"], r["n_near"]) for r in x.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [(0, 1)]


def test_an_index_of_all_terms_serves_any_test_set(spark):
    rows, items = fixture()
    docs, tests = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    index = x.build_index(docs)
    assert got(x.decontaminate(docs, tests, index=index)) == brute(rows, items)


def test_empty_tables(spark):
    docs, none = documents(spark, [(1, "a b c")]), spark.createDataFrame([], "item_id long, text string")
    assert got(x.decontaminate(docs, none)) == [(1, 3, 0, ())]
    assert got(x.decontaminate(documents(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string"))) == []
    assert x.digest(x.decontaminate(docs, none)).first()["contaminated"] is False
