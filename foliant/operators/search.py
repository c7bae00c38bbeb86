"""Substring search over postings of character trigrams.

A text is posted under every run of three characters in it, a shorter one under itself. A search text of three or more
characters is looked up by its rarest trigram, and the second rarest unless that is much more frequent, one of one or two characters by the trigrams that hold it; each
candidate's own columns are checked then. All of it is equality joins: no pair of a search text and a row is formed that
shares no trigram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.runtime import checkpointed, counted_join_side, make_importable

SIZE = 3
#: A gram in the postings is a long of three characters' 21 bits each; FILL stands for what a shorter one lacks.
BITS, FILL = 21, (1 << 21) - 1
#: The second rarest trigram is left out if so many times as many rows hold it: reading its postings then takes more than checking the rows that it rules out.
OFTENER = 2
#: Search texts are cut to so many characters.
LONGEST = 200


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, in one pass over it; a shorter text is its own only one, an empty or null one has none."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{SIZE}}}))."), F.lit(1))
    return F.when(F.length(text) >= SIZE, F.array_distinct(runs)).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def packed(one, two, three):
    """Three characters' numbers, in arrays or columns of longs, as one."""
    if isinstance(one, Column):
        return F.shiftleft(one, 2 * BITS).bitwiseOR(F.shiftleft(two, BITS)).bitwiseOR(three)
    return one << 2 * BITS | two << BITS | three


def code(gram: Column) -> Column:
    """A text of one to three characters as the postings have it."""
    return packed(*[F.when(F.length(gram) > i, F.ascii(F.substring(gram, i + 1, 1))).otherwise(FILL).cast("long") for i in range(SIZE)])


def gram_codes(texts: tuple[str | None, ...]) -> np.ndarray:
    """The distinct grams of a row's texts, those of grams(), as longs."""
    found = [np.zeros(0, np.int64)]
    for t in filter(None, texts):
        chars = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
        chars = np.append(chars, [FILL] * (SIZE - len(chars))) if len(chars) < SIZE else chars
        found.append(packed(chars[:-2], chars[1:-1], chars[2:]))
    return np.unique(np.concatenate(found))


@dataclass(frozen=True)
class TrigramIndex:
    """postings (gram, key) and counts (gram, n) of a table's columns."""

    postings: DataFrame
    counts: DataFrame

    @classmethod
    def over(cls, df: DataFrame, key: str, *columns: Column) -> TrigramIndex:
        """An index of this session: counts in the shared folder; postings are made as a lookup passes over the rows, which takes less
        than to write them all."""
        held = cls.rows(df, key, *columns)
        return cls(held, checkpointed(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))))

    @staticmethod
    def rows(df: DataFrame, key: str, *columns: Column) -> DataFrame:
        make_importable(df.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    found = [gram_codes(texts) for texts in zip(*[c.to_pylist() for c in part.columns[1:]], strict=True)]
                    lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), np.concatenate(found))
                    yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=["key", "grams"])

        rows = df.select(F.col(key).alias("key"), *[c.cast("string").alias(f"_c{i}") for i, c in enumerate(columns)])
        each = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, grams array<long>")
        return each.select(F.explode("grams").alias("gram"), "key")

    @classmethod
    def write(cls, df: DataFrame, key: str, *columns: Column, folder: str) -> None:
        """The same, kept in a folder: postings in files by ranges of the gram, so that a lookup reads few of them."""
        by_gram = cls.rows(df, key, *columns).repartitionByRange("gram", "key").sortWithinPartitions("gram", "key")
        by_gram.write.mode("overwrite").parquet(f"{folder}/postings")
        postings = df.sparkSession.read.parquet(f"{folder}/postings")
        postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/counts")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> TrigramIndex:
        return cls(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/counts"))

    def probes(self, needles: DataFrame) -> DataFrame:
        """(needle, need, gram): the trigrams that search texts of three or more characters are looked up by, all of which (need) a row must hold."""
        long = needles.where(F.length("needle") >= SIZE).select("needle", F.explode(F.transform(grams(F.col("needle")), code)).alias("gram"))
        known = self.counts.join(counted_join_side(checkpointed(long)), "gram", "right")
        rarest = known.groupBy("needle").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, 2).alias("two"))
        alone = F.get("two", F.lit(1))["n"] > OFTENER * F.col("two")[0]["n"]
        asked = rarest.where(F.col("two")[0]["n"] > 0).withColumn("two", F.when(alone, F.slice("two", 1, 1)).otherwise(F.col("two")))
        return asked.select("needle", F.size("two").alias("need"), F.explode("two.gram").alias("gram"))

    def candidates(self, needles: DataFrame) -> DataFrame:
        """(needle, key) of the rows that may contain a needle, each pair once."""
        probes = self.probes(needles)
        fill, chars = F.lit(FILL).cast("long"), [F.shiftright("gram", at * BITS).bitwiseAND(FILL) for at in (2, 1, 0)]
        parts = [*[packed(c, fill, fill) for c in chars], *[packed(c, after, fill) for c, after in zip(chars, chars[1:], strict=False)]]
        within = self.counts.select("gram", F.explode(F.array_distinct(F.array(*parts))).alias("part"))
        brief = checkpointed(needles.where(F.length("needle").between(1, SIZE - 1)).select("needle", code(F.col("needle")).alias("part")))
        short = within.join(counted_join_side(brief), "part").select("needle", F.lit(1).alias("need"), "gram").distinct()
        found = self.postings.join(counted_join_side(checkpointed(probes.unionByName(short))), "gram")
        return found.groupBy("needle", "key").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need").select("needle", "key")


def containing(needles: DataFrame, index: TrigramIndex, rows: DataFrame, key: str, *columns: Column) -> DataFrame:
    """Distinct (needle, key): the rows of which one of the columns contains the search text as it stands. needles has the
    column `needle`; empty and null ones find nothing here, repeated ones are looked up once."""
    wanted = needles.select(F.substring("needle", 1, LONGEST).alias("needle")).where("needle <> ''").distinct()
    held = rows.select(F.col(key).alias("key"), *[c.alias(f"_c{i}") for i, c in enumerate(columns)])
    hit = reduce(Column.__or__, [F.coalesce(F.contains(f"_c{i}", F.col("needle")), F.lit(False)) for i in range(len(columns))])
    candidates = counted_join_side(checkpointed(index.candidates(checkpointed(wanted))))
    return held.join(candidates, "key").where(hit).select("needle", "key")


def match_contained(new: DataFrame, stored: DataFrame, index: TrigramIndex | None = None, most: int = 100) -> DataFrame:
    """new rows (key, url, title) with `match`: of the `most` stored rows updated last whose title, author or description
    contains the title, the latest that has the same address or title; null if there is none. stored: id, url, title,
    author, description, updated_at."""
    columns = [F.col(c) for c in ("title", "author", "description")]
    index = index or TrigramIndex.over(stored, "id", *columns)
    pairs = containing(new.select(F.col("title").alias("needle")), index, stored, "id", *columns)
    newest = Window.partitionBy("needle").orderBy(F.desc("updated_at"), F.desc("id"))
    known = pairs.join(stored.select(F.col("id").alias("key"), F.col("url").alias("_url"), F.col("title").alias("_title"), "updated_at"), "key")
    first = known.withColumn("id", F.col("key")).withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= most)
    asked = new.select("url", "title").distinct().withColumn("needle", F.substring("title", 1, LONGEST))
    same = asked.join(first, "needle").where((F.col("_url") == F.col("url")) | (F.col("_title") == F.col("title")))
    best = same.groupBy(F.col("url").alias("_of_url"), F.col("title").alias("_of_title")).agg(F.min_by("id", "_rank").alias("match"))
    return new.join(best, F.col("url").eqNullSafe(F.col("_of_url")) & (F.col("title") == F.col("_of_title")), "left").select(*new.columns, "match")
