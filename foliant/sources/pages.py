"""Page sources: a registry of readers with a fallback, stored pages, and a Python data source for fetched ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from foliant.functions.text import escape_html, page_title
from foliant.functions.urls import is_safe_url

PAGE = "url string, html string, final_url string, status_code int"
Fetch = Callable[[str], tuple[str, str, int]]
_SOURCES: dict[str, Callable[[SparkSession, DataFrame], DataFrame]] = {}
DEFAULT = "stored"


def register_source(name: str, read: Callable[[SparkSession, DataFrame], DataFrame]) -> None:
    """A source turns rows with a url into rows of PAGE, one each, with their other columns."""
    _SOURCES[name] = read


def source(name: str | None) -> Callable[[SparkSession, DataFrame], DataFrame]:
    return _SOURCES.get(name or DEFAULT, _SOURCES[DEFAULT])


def source_names() -> list[str]:
    return sorted(_SOURCES)


def stored_pages(pages: DataFrame) -> Callable[[SparkSession, DataFrame], DataFrame]:
    """The pages of a table (url, html), of several of one address the greatest; addresses that aren't safe are not looked up."""

    def read(spark: SparkSession, urls: DataFrame) -> DataFrame:
        held = pages.groupBy("url").agg(F.max("html").alias("html"))
        found = urls.where(is_safe_url(F.col("url"))).join(held, "url", "left")
        return found.select(*urls.columns, "html", F.col("url").alias("final_url"), F.when(F.col("html").isNull(), 404).otherwise(200).alias("status_code"))

    return read


class FetchedPages(DataSource):
    """`spark.read.format("fetched_pages").option("urls", lines)`: one partition per address, fetched on the executors by a
    function given as `fetch` in a subclass, so that a session decides what may be reached."""

    fetch: Fetch | None = None
    most_bytes = 10 * 1024 * 1024

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader([u for u in self.options.get("urls", "").split("\n") if u], type(self).fetch, self.most_bytes)


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], fetch: Fetch | None, most: int) -> None:
        self.urls, self.fetch, self.most = urls, fetch, most

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.fetch is None:
            raise ValueError("fetched_pages needs a fetch function")
        page, final, status = self.fetch(partition.value)
        if len(page.encode()) > self.most:
            raise ValueError(f"{partition.value} is over {self.most} bytes")
        yield partition.value, page.removeprefix("﻿"), final, status


def preview(pages: DataFrame, most: int = 50_000) -> DataFrame:
    """Pages cut for display, with title and truncated, other columns as they are."""
    others = [c for c in pages.columns if c not in ("title", "html", "truncated")]
    return pages.select(*others, page_title(F.col("html")).alias("title"), F.substring("html", 1, most).alias("html"), (F.length("html") > most).alias("truncated"))


def record_html(fields):
    """A map of field texts as an HTML fragment, nulls left out, values escaped, in the map's order."""
    entries = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull())
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit('<div class="'), e["key"], F.lit('">'), escape_html(e["value"]), F.lit("</div>"))), "\n")


def provider_page(body):
    """The page of a cloud browser's reply, whichever of the known fields holds it, as a whole document."""
    r = F.from_json(body, "html string, content string, data struct<html:string,content:string>, result string")
    page = F.coalesce(r["html"], r["content"], r["data"]["html"], r["data"]["content"], r["result"])
    return F.when(F.lower(page).contains("<html"), page).otherwise(F.concat(F.lit("<html><body>"), page, F.lit("</body></html>")))


def json_shape(json: Column, most_chars: int = 1 << 20) -> Column:
    """struct<depth, keys> of a JSON body: how deep its deepest value lies (a bare one: 0) and the most keys of one object;
    null for what isn't JSON, is over the limit, or repeats a key in an object.

    Strings and empty containers stand for any bare value; what opens and closes around the others is followed in one pass,
    with the keys so far of each container that is open.
    """
    json = F.when(F.length(json) <= most_chars, json)
    bare = F.regexp_replace(F.regexp_replace(json, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '"'), r"\[\s*\]|\{\s*\}", '"')
    marks = F.regexp_extract_all(bare, F.lit(r"[\[\]{}:]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("keys"), F.lit(0).alias("ends"), F.array().cast("array<int>").alias("open"))

    def step(s, c):
        rest = F.slice(s["open"], F.lit(2), F.size(s["open"]))
        now = F.when(c.isin("[", "{"), F.concat(F.array(F.lit(0)), s["open"])).when(c == ":", F.concat(F.array(s["open"][0] + 1), rest)).otherwise(rest)
        keys = F.greatest(s["keys"], F.when(c == ":", s["open"][0] + 1).otherwise(0))
        return F.struct(F.greatest(s["depth"], F.size(now)).alias("depth"), keys.alias("keys"), (s["ends"] + F.when(F.size(now) == 0, 1).otherwise(0)).alias("ends"), now.alias("open"))

    shape = F.aggregate(marks, start, step)
    one = F.when(shape["ends"] == 0, bare.rlike(r'^\s*("|[^\s"\[\]{},:]+)\s*$')).otherwise((shape["ends"] == 1) & bare.rlike(r"^\s*[\[{][\s\S]*[\]}]\s*$"))  # the parser stops after a value
    return F.when(F.try_parse_json(json).isNotNull() & one, F.struct(shape["depth"].alias("depth"), shape["keys"].alias("keys")))


def json_depth_ok(json: Column, most: int = 20) -> Column:
    """Whether a body is JSON within the size limit, nested no deeper than allowed."""
    return F.coalesce(json_shape(json)["depth"] <= most, F.lit(False))


def json_keys_ok(json: Column, most: int = 200) -> Column:
    """Whether no object of a body has more keys than allowed; false for what isn't JSON."""
    return F.coalesce(json_shape(json)["keys"] <= most, F.lit(False))


def nested_record_html(json: Column) -> Column:
    """A JSON record as a page: texts as blocks of their field, lists a block for each item, objects their fields as spans;
    nulls and bare numbers of the top level are left out, values escaped, fields in the record's order. Null for what isn't
    JSON; a body of another kind than a record is an empty page."""
    record, kinds = "map<string,string>", "map<string,variant>"
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    block = lambda key, inner, mark="": F.concat(F.lit('<div data-field="'), key, F.lit(f'"{mark}>'), inner, F.lit("</div>"))

    def spans(text):
        entries = F.filter(F.map_entries(F.from_json(text, record)), lambda e: e["value"].isNotNull())
        return F.array_join(F.transform(entries, lambda e: F.concat(F.lit('<span data-field="'), e["key"], F.lit('">'), escape_html(e["value"]), F.lit("</span>"))), " ")

    def items(key, text):
        of = F.transform(F.from_json(text, "array<variant>"), kind)
        shown = F.zip_with(F.from_json(text, "array<string>"), of, lambda t, k: F.when(k == "STRING", block(key, escape_html(t))).when(k == "OBJECT", block(key, spans(t), ' data-item="true"')))
        return F.filter(shown, lambda b: b.isNotNull())

    def blocks(e, k):
        one = F.when(k == "STRING", block(e["key"], escape_html(e["value"]))).when(k == "OBJECT", block(e["key"], spans(e["value"])))
        return F.when(k == "ARRAY", items(e["key"], e["value"])).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))

    of = F.transform(F.map_entries(F.from_json(json, kinds)), lambda e: F.coalesce(kind(e["value"]), F.lit("VOID")))
    body = F.array_join(F.flatten(F.zip_with(F.map_entries(F.from_json(json, record)), of, blocks)), "\n")
    return F.when(F.try_parse_json(json).isNotNull(), F.concat(F.lit("<html><body>"), F.coalesce(body, F.lit("")), F.lit("</body></html>")))


def probe(spark: SparkSession) -> DataFrame:
    """One row: the session answers."""
    return spark.range(1).select(F.lit(1).alias("ok"))
