"""Text files of books of any size: a book's chapters are pieces of its text, in files by ranges of (book, chapter).

Pieces are range-partitioned by book, order and id, so a large book covers several files and a file holds many small
books. A chapter's place in its book, and a piece's offset in its text, come from the partitions: each counts its own
rows, and what the partitions before hold of its first book is added. The manifest tells for each piece where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import fill_template
from foliant.operators.export import ExportConfig, book_values, chapter_text, text_name
from foliant.runtime import checkpointed


def _running(batches: Iterator[pa.RecordBatch], key: str, size: str | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, sum of `size` (or rows) before each row in its book and partition, the same over all books, whether it's the partition's first book)."""
    at, of_all, book, first = 0, 0, None, True
    for b in batches:
        keys = b.column(key)
        sizes = b.column(size).to_numpy(zero_copy_only=False) if size else np.ones(len(b), dtype=np.int64)
        new = np.ones(len(b), dtype=bool)
        new[1:] = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False) if len(b) > 1 else new[1:]
        new[0] = book is None or keys[0].as_py() != book[0]
        total = np.cumsum(sizes) - sizes
        starts = np.flatnonzero(new)
        base = np.zeros(len(b), dtype=np.int64)
        run = np.cumsum(new) - 1
        base[run >= 0] = total[starts[run[run >= 0]]]
        local = total - base
        local[run < 0] += at
        if book is not None and new.any():
            lead = np.cumsum(new) == 0
        else:
            lead = np.cumsum(new) <= 1 if book is None else np.ones(len(b), dtype=bool)
        yield b, local, total + of_all, lead & first
        first = first and bool(lead.all())
        at, of_all, book = int(local[-1] + sizes[-1]), of_all + int(sizes.sum()), (keys[-1].as_py(),)


def _with_running(dealt: DataFrame, key: str, size: str | None, name: str, in_part: str | None = None) -> DataFrame:
    """dealt, whose partitions are ranges of the key, with the sum of `size` before each row in its book."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = tail = first = last = None
        for b, local, _, lead in _running(batches, key, size):
            sizes = b.column(size).to_numpy(zero_copy_only=False) if size else np.ones(len(b), dtype=np.int64)
            first = b.column(key)[0].as_py() if head is None else first
            head = (head or 0) + int(sizes[lead].sum())
            last, tail, alone = b.column(key)[len(b) - 1].as_py(), int(local[-1] + sizes[-1]), bool(lead.all())
        if head is not None:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": str(first), "last": str(last), "head": head, "tail": tail, "alone": alone}])

    carried, book, so_far = {}, None, 0
    for r in dealt.select(key, *([size] if size else [])).mapInArrow(ends, "part long, first string, last string, head long, tail long, alone boolean").orderBy("part").toLocalIterator():
        carried[r["part"]] = so_far if r["first"] == book else 0
        book, so_far = r["last"], (carried[r["part"]] + r["head"]) if r["alone"] else r["tail"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = carried.get(TaskContext.get().partitionId(), 0)
        for b, local, of_all, lead in _running(batches, key, size):
            more = [pa.array(local + np.where(lead, before, 0))] + ([pa.array(of_all)] if in_part else [])
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, name, *([in_part] if in_part else [])])

    kinds = ", ".join(f"`{c}` {k}" for c, k in dealt.dtypes)
    return dealt.mapInArrow(add, f"{kinds}, {name} long" + (f", {in_part} long" if in_part else ""))


def export_pieces(books: DataFrame, chapters: DataFrame, key: str, config: ExportConfig, today: Column) -> DataFrame:
    """(key, file_name, seq, text) of books (key, title, author) and chapters (key, sort_order, id, title, content): the texts
    of a book, joined in the order of seq, are what export_text gives. A book without chapters is one piece. The rows are in
    partitions by ranges of book and chapter, in order."""
    told = chapters.groupBy(key).agg(F.sum(F.length(F.coalesce("content", F.lit("")))).alias("_words"), F.count(F.lit(1)).alias("_n"))
    held = chapters.select(F.col(key).alias("_key"), "sort_order", "id", F.struct("title", "content").alias("_chapter"))
    rows = books.select(key, "title", "author").join(told, key, "left").join(held, F.col(key) == F.col("_key"), "left").drop("_key")
    parts = int(books.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(parts, key, "sort_order", "id").sortWithinPartitions(key, "sort_order", "id"))
    numbered = _with_running(dealt, key, None, "seq")
    values = book_values(F.col("_words"), F.col("_n"), today)
    text = F.when(F.col("_n").isNull(), "").otherwise(chapter_text(F.col("_chapter"), F.col("seq"), values, config))
    text = F.concat(F.when(F.col("seq") > 0, "\n").otherwise(""), text)
    if config.site_info:
        info = fill_template(F.lit(config.site_info), values)
        text = F.concat(F.when(F.col("seq") == 0, F.concat(info, F.lit("\n\n"))).otherwise(""), text, F.when(F.col("seq") + 1 >= F.coalesce("_n", F.lit(0)), F.concat(F.lit("\n"), info)).otherwise(""))
    return numbered.select(key, text_name(values, config).alias("file_name"), "seq", F.coalesce(text, F.lit("")).alias("text"))


def write_pieces(pieces: DataFrame, key: str, folder: str) -> DataFrame:
    """Write export_pieces' texts to folder/texts and their manifest to folder/manifest, and return that: (key, file_name, seq,
    part, part_offset, offset, n_bytes). Piece seq of a book is the n_bytes bytes at part_offset of the file part-<part>,
    and starts at `offset` of the book's text. Each piece ends with a line feed of the file's own, if it has none."""
    pieces = checkpointed(pieces)
    bare = F.regexp_replace("text", r"\n\z", "")
    pieces.select(bare.alias("value")).write.mode("overwrite").text(f"{folder}/texts")
    n_bytes, kept = F.octet_length("text").cast("long"), F.octet_length(bare).cast("long") + 1
    sized = pieces.select(key, "file_name", "seq", F.spark_partition_id().alias("part"), n_bytes.alias("n_bytes"), kept.alias("_kept"))
    placed = _with_running(_with_running(sized, key, "n_bytes", "offset"), key, "_kept", "_of_book", "part_offset")
    placed.select(key, "file_name", "seq", "part", "part_offset", "offset", "n_bytes").write.mode("overwrite").parquet(f"{folder}/manifest")
    return pieces.sparkSession.read.parquet(f"{folder}/manifest")


def book_bytes(spark: SparkSession, folder: str, key: str, book, read: Callable[[int, int, int], bytes]) -> Iterator[bytes]:
    """A book's text, piece by piece; read(part, offset, size) gives bytes of a file."""
    for r in spark.read.parquet(f"{folder}/manifest").where(F.col(key) == F.lit(book)).orderBy("seq").toLocalIterator():
        yield read(r["part"], r["part_offset"], r["n_bytes"])
