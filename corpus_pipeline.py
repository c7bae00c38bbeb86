"""The corpus pipeline: five stages from the documents table to token ids.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet to the shared folder and reread
as the next one's docs. All but the last return the columns of documents, other columns too, under whatever name.

A stage decides on rows by doc_id and text: rows that repeat a doc_id with other texts are judged each by their own,
and a null doc_id is one like any other. A null text counts as empty; empty and very long texts are judged as all others. An
empty documents table passes through; with no labels nothing is toxic, with no benchmark items nothing is contaminated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontam, exact_dedup, near_dedup, spiece, toxicity
from foliant.llm.common import delete, drop_rows, materialise, scratch, scratch_root, table, text_digest
from foliant.llm.queries import PIECES


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.5 go. The model is fitted on the labelled rows outside of the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return drop_rows(docs, toxicity.score(docs, model).where("predicted = 1"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the largest doc_id stays; of rows equal in doc_id and text, one."""
    rows = exact_dedup.dedup_table(docs)
    left = drop_rows(docs, rows.where("NOT kept"))
    again = materialise(rows.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1"), "again")
    if again.isEmpty():
        return left
    one = drop_rows(left, again, "left_semi").withColumn("_sha", text_digest())
    single = one.dropDuplicates(["doc_id", "_sha"]).drop("_sha")
    return drop_rows(left, again).unionByName(single)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the smallest doc_id stays; a class without any doc_id stays whole."""
    return drop_rows(docs, near_dedup.near_duplicates(docs).where("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return drop_rows(docs, found.where("n_hit > 0"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return spiece.digest(spiece.encode(docs, PIECES, decoded=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]

#: Compression distance, order MinHash and Viterbi paths can't be put in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's scratch tables go once its output is written, and its input after that."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):
            done = stage(spark, docs, sf_dir)
            done.write.parquet(path)
            docs = spark.read.schema(done.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
