"""Text export of a parent with its ordered children, and search keywords."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import confusion_block, file_name, fill_template, paragraphs

# Fixed lists: the endings of search phrases and the engines they are meant for.
TITLE_ENDINGS = ("全文免费阅读", "无弹窗", "最新章节", "笔趣阁", " TXT下载", "全文阅读", "无弹窗全文", "大结局", "最新更新", "章节目录")
AUTHOR_ENDINGS = ("作品集", "全部小说", "新书")


@dataclass(frozen=True)
class ExportConfig:
    """What is put between chapters; texts are templates."""

    ad: str = ""
    ad_every: int = 50
    ad_at: str = "end"
    confusion: str = ""
    site_info: str = ""
    name: str = "{title} - {author}"
    seed: int = 1


def chapter_text(chapter: Column, i: Column, values: dict[str, Column], config: ExportConfig) -> Column:
    """The text of the chapter (title, content) at place i, counted from 0, of its book."""
    due = ((i + 1) % max(1, config.ad_every) == 0) if config.ad else F.lit(False)
    ad = F.concat(F.lit("\n"), fill_template(F.lit(config.ad), {**values, "chapterTitle": chapter["title"]}), F.lit("\n\n"))
    here = lambda place: F.when(due & F.lit(config.ad_at == place), ad).otherwise("")
    ps = paragraphs(F.coalesce(chapter["content"], F.lit("")))
    last, middle = F.size(ps) - 1, F.floor(F.size(ps) / 2)

    def paragraph(p: Column, j: Column) -> Column:
        text = F.concat(F.when(j == middle, here("middle")).otherwise(""), p, F.lit("\n\n"))
        if config.confusion:
            text = F.concat(text, F.when(j < last, F.concat(confusion_block(F.lit(config.confusion), config.seed), F.lit("\n\n"))).otherwise(""))
        return text

    return F.concat(here("start"), F.coalesce(chapter["title"], F.lit("")), F.lit("\n\n"), F.array_join(F.transform(ps, paragraph), ""), here("end"))


def book_values(words: Column, n: Column, today: Column) -> dict[str, Column]:
    """What a book's templates can name."""
    return {
        "title": F.col("title"),
        "author": F.col("author"),
        "wordCount": F.coalesce(words, F.lit(0)).cast("string"),
        "chapterCount": F.coalesce(n, F.lit(0)).cast("string"),
        "date": F.date_format(today, "yyyy-MM-dd"),
        "siteName": F.lit("本站"),
    }


def text_name(values: dict[str, Column], config: ExportConfig) -> Column:
    return file_name(F.concat(fill_template(F.lit(config.name or ExportConfig.name), values), F.lit(".txt")))


def export_text(books: DataFrame, chapters: DataFrame, key: str, config: ExportConfig, today: Column) -> DataFrame:
    """(key, file_name_text, text, n_bytes) per book (key, title, author) of its chapters (key, sort_order, id, title, content).

    A book is one text, so one row holds it; books are dealt over the cluster by their key. `textsink` writes books of any
    size.
    """
    ordered = F.array_sort(F.collect_list(F.struct("sort_order", "id", "title", "content")))
    told = chapters.groupBy(key).agg(ordered.alias("chapters"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("words"), F.count(F.lit(1)).alias("n"))
    rows = books.join(told, key, "left").withColumn("chapters", F.coalesce("chapters", F.array().cast(dict(told.dtypes)["chapters"])))
    values = book_values(F.col("words"), F.col("n"), today)
    text = F.array_join(F.transform("chapters", lambda c, i: chapter_text(c, i, values, config)), "\n")
    if config.site_info:
        info = fill_template(F.lit(config.site_info), values)
        text = F.concat(info, F.lit("\n\n"), text, F.lit("\n"), info)
    return rows.select(key, text_name(values, config).alias("file_name"), text.alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))


def search_keywords(books: DataFrame, key: str) -> DataFrame:
    """(key, keyword, source, at) of books (key, title, author, category, tags): each pair once, in order."""
    title, author, category = F.col("title"), F.col("author"), F.col("category")
    named = F.coalesce(category, F.lit("")) != ""

    def pair(keyword: Column, source: str) -> Column:
        return F.struct(keyword.alias("keyword"), F.lit(source).alias("source"))

    fixed = [pair(F.concat(title, F.lit(e)), "百度") for e in TITLE_ENDINGS] + [pair(F.concat(author, F.lit(e)), "搜狗") for e in AUTHOR_ENDINGS]
    of_category = F.array(pair(F.concat(category, F.lit("小说推荐")), "必应"), pair(F.concat(category, F.lit("小说排行榜")), "必应"), pair(F.concat(F.lit("热门"), category, F.lit("小说")), "360搜索"))
    of_tags = F.transform(F.slice("tags", 1, 3), lambda t: pair(F.concat(t, F.lit("小说推荐")), "神马搜索"))
    mixed = F.array(pair(F.concat(title, author), "百度"), pair(F.concat(title, F.lit("在线阅读")), "搜狗"), pair(F.concat(title, F.lit("txt")), "360搜索"))
    none = F.slice(of_category, 1, 0)
    found = F.array_distinct(F.concat(F.array(*fixed), F.when(named, of_category).otherwise(none), F.coalesce(of_tags, none), mixed))
    return books.select(key, F.posexplode(found).alias("at", "k")).select(key, "k.keyword", "k.source", "at")


def every_nth(rows: DataFrame, parent: str, order: list[str], n: int) -> DataFrame:
    """Rows with `nth`: whether their place within the parent is a multiple of n."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(parent).orderBy(*order)) % n == 0)


def write_texts(exported: DataFrame, folder: str, key: str) -> None:
    """Exported books as text files, a folder for each key and file name, so that equal names stay apart."""
    exported.select(key, "file_name", "text").write.mode("append").partitionBy(key, "file_name").text(folder)
