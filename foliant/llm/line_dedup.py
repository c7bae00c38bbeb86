"""Line dedup with levelled sorted runs of line hashes, in DataFrame operations only.

Documents arrive in batches of ascending doc_id. A batch's lines become keys (trimmed, A-Z lower-cased, at least ten
code points), a key 16 bytes of its SHA-256. The keys of a batch, one row each after partial aggregation, are dealt to the
store's buckets, which are the session's shuffle partitions, and merged with the runs: a run is a bucketed table
with one sorted file for each bucket, so the merge joins neither shuffle nor sort it. The marked keys are the batch's run on
level 0; those that an older run holds are skipped when it is read. FANOUT runs of a level are merged into one of the next, bucket by
bucket, so a store of n batches holds O(log n) runs.

A line goes if its key is in a run (an earlier, hence smaller, doc_id holds it) or if a smaller doc_id of the batch
holds it. Only keys that some line loses join back to the lines, by the key, and Spark's skew join may split a
key that a third of all lines share, since the other side has one row for it.

Defined results: null or empty text is one empty line; keys under ten code points never go; a line repeated within
one document stays as often as it is there; rows without doc_id keep all lines and hold none; rows that repeat a
doc_id count as one document, each keeping its own lines; a very long text loses its lines in one pass over them; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import body, lower_ascii, materialise, settled

MIN_KEY = 10
FANOUT = 2
BATCHES = 4
#: Lets Spark rely on the order within a bucket that is one file.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


class RunStore:
    """The runs, by level. A run is a bucketed and sorted table of keys in the warehouse all executors share."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.ordered = spark.conf.get(ORDERED)
        spark.conf.set(ORDERED, "true")

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("NOT old").select("key")

    def runs(self) -> list[DataFrame]:
        return [self._run(name) for level in self.levels for name in level]

    def _write(self, keys: DataFrame) -> str:
        """A table of keys that are dealt to the buckets already, so that each bucket is one file."""
        name = f"line_run_{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").saveAsTable(name)
        return name

    def add(self, lines: DataFrame) -> DataFrame:
        """A new run of the keys of (key, doc_id). Returns (key, first, last, old): the least and greatest doc_id of each key
        in the batch, and whether an older run holds it; read it before compact()."""
        keys = lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            keys = keys.repartition(self.buckets, "key")
        name = self._write(self.mark(keys))
        self.levels[0].append(name)
        return self.spark.table(name)

    def merged(self, names: list[str]) -> DataFrame:
        """The keys of several runs, which have none in common, merged bucket by bucket."""
        tables = [self._run(n) for n in names]
        return reduce(lambda a, b: a.join(b, "key", "full"), tables).withColumn("old", F.lit(False))

    def compact(self) -> None:
        """Full levels are merged upwards."""
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names = self.levels[level]
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self._write(self.merged(names)))
            self.levels[level] = []
            for n in names:
                self.spark.sql(f"DROP TABLE {n}")
            level += 1

    def mark(self, keys: DataFrame) -> DataFrame:
        """keys with `old`: whether some run holds the key. Keys are unique, so each merge is one row against at most one."""
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.withColumn(f"_in{i}", F.lit(True)).hint("merge"), "key", "left")
        held = [F.col(f"_in{i}") for i in range(len(self.runs()))]
        return keys.withColumn("old", F.coalesce(*held, F.lit(False))).drop(*[f"_in{i}" for i in range(len(held))])

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = [[]]
        self.spark.conf.set(ORDERED, self.ordered)


def _lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, mark, at): every line with a long enough key; mark tells texts of the same doc_id apart."""
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keyed = lines.select("doc_id", "mark", "at", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= MIN_KEY)
    return keyed.select(F.substring(F.unhex(F.sha2(F.col("k").cast("binary"), 256)), 1, 16).alias("key"), "doc_id", "mark", "at")


def _mark_batch(lines: DataFrame, store: RunStore) -> DataFrame:
    """(doc_id, mark, gone): the line numbers each document of the batch loses. Adds the batch's run to the store."""
    keys = store.add(lines.select("key", "doc_id"))
    losing = keys.where("old OR first < last").select("key", F.when(~F.col("old"), F.col("first")).alias("first"))
    lost = lines.join(losing, "key").where("first IS NULL OR doc_id > first")
    gone = materialise(lost.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("gone")), "gone")
    store.compact()
    return gone


def dedup_batch(docs: DataFrame, store: RunStore) -> DataFrame:
    """(doc_id, mark, gone) of documents (doc_id, text) that arrive after all that the store has seen."""
    return _mark_batch(materialise(_lines(docs), "lines"), store)


@settled("gone")
def lost_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, mark, gone) of the documents that lose lines. The text is read once; batches are ranges of doc_id."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    batch = sum([(F.col("doc_id") > c).cast("int") for c in sorted(set(cuts or []))], F.lit(0))
    lines = materialise(_lines(docs).withColumn("batch", batch), "lines", by="batch")
    store = RunStore(spark)
    try:
        parts = [_mark_batch(lines.where(F.col("batch") == i).drop("batch"), store) for i in range(batches)]
        return reduce(DataFrame.unionByName, parts)
    finally:
        store.drop()


def _without(lines: Column, gone: Column) -> Column:
    """The lines whose numbers aren't in gone, in order; linear in both."""

    def kept(x: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")

    return F.element_at(F.transform(F.array(lines), kept), 1)


def dedup_lines(docs: DataFrame, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row, texts without the lines that a smaller doc_id holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body(text).alias("text"))
    gone = lost_lines(docs, batches)
    joined = docs.withColumn("mark", F.xxhash64("text")).join(gone, ["doc_id", "mark"], "left")
    lines = F.split("text", "\n", -1)
    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(lines, F.col("gone"))).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
