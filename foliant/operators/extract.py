"""Rules (rows of selectors as JSON) compiled to Columns, and the run of a rule over list, book and chapter pages."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import markup, text
from foliant.functions.rules import KINDS
from foliant.functions.urls import resolve_url
from foliant.operators import crawl
from foliant.operators.search import match_contained
from foliant.runtime import checkpointed

#: Rule fields by the record field they fill.
BOOK = {"title": "bookTitleSelector", "author": "bookAuthorSelector", "description": "bookDescriptionSelector", "cover": "bookCoverSelector", "status": "bookStatusSelector"}
CONTENT = {"title": "contentTitleSelector", "content": "contentSelector"}


def parsed(selector: str | dict | None) -> tuple[str, str] | None:
    """(kind, value) of a selector given as JSON or dict; None if it has no known kind or no value."""
    if isinstance(selector, str):
        try:
            selector = json.loads(selector)
        except ValueError:
            return None
    if not isinstance(selector, dict) or selector.get("type") not in KINDS or not str(selector.get("value") or "").strip():
        return None
    return selector["type"], selector["value"]


def compile_fields(rule: dict, fields: dict[str, str]) -> dict[str, tuple[str, str]]:
    """The fields that a rule has usable selectors for."""
    return {name: s for name, column in fields.items() if (s := parsed(rule.get(column)))}


def book_columns(rule: dict, html: Column, url: Column, sources: tuple[str, ...] = ()) -> dict[str, Column]:
    """Columns of a book page: its fields ('' where the rule has none; the status as one of three; those of `sources` as the page has
    them written) and its chapter links."""
    fields = compile_fields(rule, BOOK)
    chapters = [parsed(rule.get(k)) for k in ("chapterListSelector", "chapterLinkSelector", "chapterTitleSelector")]
    lists = {"chapters": tuple(chapters)} if all(chapters) else {}
    got = markup.rule_fields(html, url, fields, lists, sources)
    none = F.array().cast("array<struct<title:string,url:string>>")
    out = {name: got[name] if name in fields else F.lit("") for name in BOOK}
    out["status"] = text.status_of(out["status"])
    return out | {"chapters": got["chapters"] if lists else none}


def content_columns(rule: dict, html: Column, url: Column) -> dict[str, Column]:
    """Columns of a chapter page: its title, its cleaned text."""
    fields = compile_fields(rule, CONTENT)
    got = markup.rule_fields(html, url, fields)
    out = {name: got[name] if name in fields else F.lit("") for name in CONTENT}
    own, removed = (text.pattern_list(rule.get(k)) for k in ("adPatterns", "removePatterns"))
    return out | {"content": text.clean_text(out["content"], own, removed)}


def book_addresses(rule: dict, pages: DataFrame) -> DataFrame:
    """(page_no, at, url): the addresses on the rule's list pages, each once, in reading order."""
    pager = json.loads(rule["listPagination"]) if isinstance(rule.get("listPagination"), str) else rule.get("listPagination") or {}
    starts = pages.sparkSession.createDataFrame([(rule["listUrl"],)], "url string")
    read = crawl.read_lists(starts, pages, parsed(rule["listSelector"]), pager.get("type"), pager.get("selector", ""), pager.get("maxPage"))
    listed = read.select("page_no", F.posexplode("items").alias("at", "link"), F.col("url").alias("base"))
    resolved = listed.select("page_no", "at", resolve_url(F.col("base"), F.col("link")).alias("url"))
    return crawl.first_seen(resolved, ["url"], F.col("page_no"), F.col("at"))


@dataclass(frozen=True)
class Pass:
    """What one pass of a rule found: books (url, title, author, description, cover, status, match, outcome) and chapters
    (book_url, url, title, sort_order, content, n_pages, outcome). A book is new, existing (`match` is its stored id), skipped
    (no title, or a repeat by the rule's dedupMode) or failed (its page isn't there); a chapter is new, skipped (stored
    already, or empty) or failed."""

    books: DataFrame
    chapters: DataFrame

    def counts(self) -> DataFrame:
        """One row: total_books, and how many books and chapters had each outcome."""
        books = self.books.agg(F.count_if(F.col("outcome").isin("new", "existing")).alias("total_books"), *[F.count_if(F.col("outcome") == o).alias(f"{o}_books") for o in ("new", "skipped", "failed")])
        chapters = self.chapters.agg(*[F.count_if(F.col("outcome") == o).alias(f"{o}_chapters") for o in ("new", "skipped", "failed")])
        return books.join(F.broadcast(chapters), how="cross")  # one row each


def run_pass(rule: dict, pages: DataFrame, stored_books: DataFrame, stored_chapters: DataFrame, incremental: bool = True) -> Pass:
    """A whole pass of a rule over stored pages (url, html): list pages, book pages, chapter lists, and each new chapter's content
    over its own pages, against stored books (id, url, title, updated_at; with author and description, matches are looked for
    among the latest books that contain the title) and stored chapters (book_url, url, title)."""
    html, url = F.col("html"), F.col("url")
    held = pages.groupBy("url").agg(F.max("html").alias("html"))
    listed = book_addresses(rule, pages).withColumn("place", F.concat(F.lpad(F.col("page_no").cast("string"), 6, "0"), F.lpad(F.col("at").cast("string"), 9, "0")))
    read = listed.select("url", "place").join(held, "url", "left")
    fields = F.struct(*[c.alias(n) for n, c in book_columns(rule, F.coalesce(html, F.lit("")), url).items()])
    found = checkpointed(read.select("url", "place", html.isNotNull().alias("there"), fields.alias("book")).select("url", "place", "there", "book.*"))
    titled = found.where("there AND title <> ''")
    kept = checkpointed(crawl.dedupe_books(titled, rule.get("dedupMode") or "url", "place"))
    if not incremental:
        matched = kept.withColumn("match", F.lit(None).cast(stored_books.schema["id"].dataType))
    elif {"author", "description"} <= set(stored_books.columns):
        matched = match_contained(kept, stored_books)
    else:
        matched = crawl.match_books(kept, stored_books)
    known = matched.withColumn("outcome", F.when(F.col("match").isNull(), "new").otherwise("existing"))
    left = found.join(kept.select("place"), "place", "left_anti").withColumn("match", F.lit(None).cast(known.schema["match"].dataType))
    left = left.withColumn("outcome", F.when(F.col("there"), "skipped").otherwise("failed"))
    names = ["url", *BOOK, "match", "outcome"]
    books = known.select(*names).unionByName(left.select(*names))

    links = kept.select(F.col("url").alias("book_url"), F.posexplode("chapters").alias("position", "c")).select("book_url", "position", "c.url", "c.title").withColumn("page", F.lit(0))
    numbered = checkpointed(crawl.number_chapters(links, "book_url", "page", "position").select("book_url", "url", "title", "sort_order"))
    fresh = crawl.new_chapters(numbered, stored_chapters, "book_url") if incremental else numbered
    pager = json.loads(rule["contentPagination"]) if isinstance(rule.get("contentPagination"), str) else rule.get("contentPagination") or {}
    chosen = compile_fields(rule, CONTENT)
    texts = crawl.read_contents(fresh.select("url"), pages, chosen["content"], chosen.get("title"), pager.get("type"), pager.get("selector", ""), pager.get("maxPage"))
    own, removed = (text.pattern_list(rule.get(k)) for k in ("adPatterns", "removePatterns"))
    texts = texts.withColumn("content", text.clean_text(F.col("content"), own, removed)).withColumnRenamed("title", "_title")
    done = fresh.select("book_url", "url").join(texts, "url")
    outcome = F.when(F.col("found").isNull(), "skipped").when(~F.col("found"), "failed").when(text.has_text(F.col("content")), "new").otherwise("skipped")
    chapters = numbered.join(done, ["book_url", "url"], "left").withColumn("outcome", outcome)
    content = F.when(F.col("outcome") == "new", F.col("content"))
    return Pass(books, chapters.select("book_url", "url", F.coalesce(F.nullif("_title", F.lit("")), "title").alias("title"), "sort_order", content.alias("content"), "n_pages", "outcome"))


def run_rule(rule: dict, pages: DataFrame, stored_books: DataFrame, stored_chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, chapters) that a rule finds on stored pages and keeps: those of a pass with the outcome new or existing."""
    done = run_pass(rule, pages, stored_books, stored_chapters)
    return done.books.where("outcome IN ('new', 'existing')"), done.chapters.where("outcome = 'new'").drop("n_pages", "outcome")
