"""Books written in parts: the pieces, joined, are the text of export_text."""

from __future__ import annotations

import glob
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import export, textsink

CONFIGS = (
    export.ExportConfig(ad="[{chapterTitle}/{chapterCount}]", ad_every=3, ad_at="middle", site_info="《{title}》{wordCount}"),
    export.ExportConfig(ad="AD\n{title}", ad_every=1, ad_at="start"),
    export.ExportConfig(),
)


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(6)
    books = [(f"b{i:02d}", f"Book {i} é", "A/B") for i in range(30)] + [("none", "No chapters", "N"), ("null", None, None)]
    text = lambda: "\n".join(rng.choice(["", "  ", "line one", "🙂 line", "x" * 50]) for _ in range(rng.randint(0, 6)))
    chapters = [("b07", rng.randint(0, 1500), i, f"Chapter {i}", rng.choice((None, text()))) for i in range(3000)]
    chapters += [(f"b{rng.randint(0, 29):02d}", rng.randint(0, 9), 10_000 + i, f"C{i}", text()) for i in range(400)] + [("gone", 1, 1, "orphan", "x")]
    return spark.createDataFrame(books, "k string, title string, author string"), spark.createDataFrame(chapters, "k string, sort_order int, id int, title string, content string")


@pytest.mark.parametrize("config", CONFIGS, ids=("middle", "start", "plain"))
def test_parts_make_the_text(spark, library, tmp_path, config):
    books, chapters = library
    day = F.lit("2024-01-01").cast("date")
    want = {r["k"]: (r["file_name"], (r["text"] or "").encode()) for r in export.export_text(books, chapters, "k", config, day).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        pieces = textsink.export_pieces(books, chapters, "k", config, day)
        assert max(len(p) for p in pieces.rdd.glom().collect()) < 800  # the large book isn't in one task
        manifest = textsink.write_pieces(pieces, "k", str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def read(part, offset, size):
        with open(glob.glob(f"{tmp_path}/texts/part-{part:05d}-*")[0], "rb") as f:
            f.seek(offset)
            return f.read(size)

    by_book: dict = {}
    for r in sorted(manifest, key=lambda r: (r["k"], r["seq"])):
        by_book.setdefault(r["k"], []).append(r)
    assert set(by_book) == set(want)
    for k, rows in by_book.items():
        assert [r["seq"] for r in rows] == list(range(len(rows)))
        assert [r["offset"] for r in rows] == [sum(x["n_bytes"] for x in rows[:i]) for i in range(len(rows))]
        assert {r["file_name"] for r in rows} == {want[k][0]}
        assert b"".join(read(r["part"], r["part_offset"], r["n_bytes"]) for r in rows) == want[k][1]
    assert len({r["part"] for r in by_book["b07"]}) > 4
    assert b"".join(textsink.book_bytes(spark, str(tmp_path), "k", "b03", read)) == want["b03"][1]
