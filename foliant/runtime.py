"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: A table is sent to every task only if its counted bytes are at most so many.
BROADCAST_BYTES = 32 << 20


def make_importable(spark: SparkSession) -> None:
    """Let this session's Python workers import the library from where the driver has it."""
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, have]))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder all executors share (a temporary one only where none is set)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="foliant-"))
    return df.checkpoint()


def counted_join_side(df: DataFrame) -> DataFrame:
    """A checkpointed table with the hint that its counted bytes allow: a broadcast, or else a join of two shuffled sides. Spark's own
    estimate goes by the bytes of the files, which encode repeated values in next to none."""
    width = F.lit(16 * (1 + len(df.columns)))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df.hint("merge")
