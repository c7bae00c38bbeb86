"""run() against a plain version of all stages on a small fixture, and the registered queries on the smallest tables."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from foliant.llm import queries, spiece, toxicity

from . import test_decontam, test_near_dedup, test_toxicity
from .cases import documents


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean, toxic, repeated, nearly repeated and contaminated documents with labels for a part of them."""
    rng = random.Random(12)
    texts, labels = [], []
    for i in range(260):
        toxic = i % 6 == 0
        texts.append((i, test_toxicity.text(rng, toxic) + f" ending {' '.join(rng.choice(test_near_dedup.VOCABULARY) for _ in range(40))}"))
        labels += [(i, 1, int(toxic))] if i % 5 else []
    item = " ".join(rng.choice(test_near_dedup.VOCABULARY) for _ in range(14))
    for n in range(12):
        own = texts[n * 6 + 1][1]
        texts += [(300 + n, own), (400 + n, " ".join(test_near_dedup.edited(rng, own.split(), 2)))]
        texts.append((500 + n, texts[n * 6 + 2][1] + " " + item if n % 2 else item + " and the rest of it " + str(n)))
    texts += [(900, None), (901, ""), (902, "The last one, é🙂▁.")]
    folder = tmp_path_factory.mktemp("pipeline")
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, item


def brute(spark, folder, texts, item):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(i, t) for i, t in texts if toxicity.score_texts([t or ""], model)[0] < 0.5]
    last = {t or "": max(j for j, u in rows if (u or "") == (t or "")) for _, t in rows}
    rows = [(i, t) for i, t in rows if last[t or ""] == i]
    kept = {i for i, _, k in test_near_dedup.brute(rows) if k}
    rows = [(i, t) for i, t in rows if i in kept]
    hit = {i for i, _, n, _ in test_decontam.brute(rows, [(1, item)]) if n}
    return [(i, t or "") for i, t in rows if i not in hit]


def test_against_brute_force(spark, tables):
    folder, texts, item = tables
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    want = brute(spark, folder, texts, item)
    assert sorted(got) == sorted(i for i, _ in want)
    model = spiece.load(queries.PIECES)
    assert all(got[i]["same"] and spiece.decode_ids(got[i]["ids"], model) == t for i, t in want)
    assert not any(i % 6 == 0 for i in got if i < 260), "toxic documents stay"
    assert len([i for i in got if i < 260]) > 150


def test_stages_return_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables[0]).columns == docs.columns


def test_rows_are_judged_by_id_and_text(spark):
    rows = [(5, "a text of its own"), (5, "b text"), (7, "a text of its own"), (8, "twice"), (8, "twice"), (None, "no id"), (None, "no id"), (None, None), (9, "")]
    left = corpus_pipeline.drop_exact_copies(spark, documents(spark, rows), "")
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(5, "b text"), (7, "a text of its own"), (8, "twice"), (None, "no id"), (9, "")], key=repr)


def test_each_stage_leaves_little_behind(spark, tables):
    root = corpus_pipeline.scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    corpus_pipeline.run(spark, tables[0])
    assert len(set(os.listdir(root)) - before) == 1, "only the result stays"


def test_no_labels_and_no_items(spark, tables, tmp_path):
    spark.read.parquet(f"{tables[0]}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == docs.count()


def test_empty_documents(spark, tables, tmp_path):
    spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_one_row_per_row(spark, small, name):
    table = "pages" if name == "op6_main_text" else "documents"
    assert queries.QUERIES[name](spark, small).count() == spark.read.parquet(f"{small}/{table}.parquet").count()
