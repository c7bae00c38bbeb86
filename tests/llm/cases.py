"""Rows with what real tables hold: nulls, empty and long texts, ties, repeats, columns named like the operators' own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASHING = (
    "a b at bits bucket buckets class_id counts decoded digest doc findings gone group_size held_out ids items keep_id kept key label labels line made mark "
    "main n n_hit n_items n_words near node old old_text one p pattern pos predicted rank score seen shard size spans start term text_sha256 toxic weak_label window words"
).split()


def clashing(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]], clash: bool = True) -> DataFrame:
    """A documents table; lang, source and n_chars are null in every second row."""
    full = [(i, t, "en" if k % 2 else None, "web" if k % 2 else None, len(t or "") if k % 2 else None) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return clashing(df) if clash else df


def by_id(df: DataFrame) -> dict:
    return {r["doc_id"]: r for r in df.collect()}
