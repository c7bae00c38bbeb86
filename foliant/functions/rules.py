"""Rules, selectors and parameters as Columns: lenient JSON, shapes, defaults and clamps, retry schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import ws_trim

SELECTOR = "type string, value string"
PAGINATION = "type string, selector string, maxPage double"
KINDS = ("css", "xpath", "regex")
ENGINES = ("cheerio", "playwright", "firecrawl", "agentql", "cloud-browser")
SELECTOR_FIELDS = (
    "listSelector", "bookTitleSelector", "bookAuthorSelector", "bookDescriptionSelector", "bookCoverSelector", "bookStatusSelector",
    "chapterListSelector", "chapterTitleSelector", "chapterLinkSelector", "contentSelector", "contentTitleSelector",
)


def selector(json: Column) -> Column:
    """struct<type, value> of a JSON text, null if it isn't an object with one of them."""
    s = F.from_json(json, SELECTOR)
    return F.when(s["type"].isNotNull() | s["value"].isNotNull(), s)


def json_or(json: Column, schema: str, otherwise: Column) -> Column:
    """A parsed value, or the fallback for null and malformed text."""
    valid = F.try_parse_json(json)
    return F.when(valid.isNotNull() & json.isNotNull(), F.coalesce(F.from_json(json, schema), otherwise)).otherwise(otherwise)


def selector_error(json: Column, required: bool = False) -> Column:
    """What is wrong with a selector's JSON, or null."""
    s = selector(json)
    absent = json.isNull() | (F.trim(json) == "")
    return (
        F.when(absent, F.lit("selector is required") if required else F.lit(None).cast("string"))
        .when(s.isNull(), "selector must be an object")
        .when(~F.coalesce(s["type"].isin(*KINDS), F.lit(False)), "selector type must be css, xpath or regex")
        .when(F.coalesce(F.trim(s["value"]), F.lit("")) == "", "selector value must not be empty")
    )


def pagination_error(json: Column, most: int = 10_000) -> Column:
    p = F.from_json(json, PAGINATION)
    return (
        F.when(json.isNull() | (F.trim(json) == ""), F.lit(None).cast("string"))
        .when(p["type"].isNull() & p["selector"].isNull(), "pagination must be an object")
        .when(~F.coalesce(p["type"].isin("next", "page"), F.lit(False)), "pagination type must be next or page")
        .when(p["maxPage"].isNotNull() & ~p["maxPage"].between(1, most), f"maxPage must be from 1 to {most}")
    )


def fenced_json(text: Column) -> Column:
    """The JSON of a model's reply: inside a code fence, else from the first to the last brace."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(fence != "", ws_trim(fence)).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def integer(c: Column, default: int, low: int | None = None, high: int | None = None) -> Column:
    """The leading integer of a text; none and zero give the default; then clamped."""
    leading = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"^\s*([+-]?\d+)", 1)
    n = F.coalesce(F.nullif(leading.try_cast("long"), F.lit(0)), F.lit(default))
    n = F.greatest(n, F.lit(low)) if low is not None else n
    return F.least(n, F.lit(high)) if high is not None else n


def page_number(c: Column) -> Column:
    return integer(c, 1, 1, 10_000)


def page_size(c: Column, default: int = 20, most: int = 100) -> Column:
    return integer(c, default, 1, most)


def delays(low: Column, high: Column) -> tuple[Column, Column]:
    """minDelay from 0, maxDelay up to 60,000 and not under it; a zero is taken as missing."""
    first = integer(low, 1000, 0)
    return first, F.greatest(first, integer(high, 3000, None, 60_000))


def threads(c: Column) -> Column:
    return integer(c, 3, 1, 20)


def progress(c: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def stage_progress(stage: Column, done: Column, total: Column) -> Column:
    """5 to 20 over the books, 20 to 50 over the lists, 50 to 95 over the chapters, 100 at the end."""
    share = done / F.greatest(total, F.lit(1))
    at = F.when(stage == "books", 5 + share * 15).when(stage == "lists", 20 + share * 30).when(stage == "chapters", 50 + share * 45).when(stage == "end", 100.0)
    return progress(F.coalesce(at, F.lit(0.0)))


# The labels of the three states.
STATUS_LABELS = {"ongoing": "连载中", "completed": "已完结", "hiatus": "暂停"}


def label(code: Column, labels: dict[str, str] = STATUS_LABELS) -> Column:
    """The label of a code; unknown codes are their own."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[code], code)


def in_domain(code: Column, domain) -> Column:
    """Whether a code is one of the allowed; null isn't."""
    return F.coalesce(code.isin(*domain), F.lit(False))


def only_if(flag: Column, value: Column) -> Column:
    return F.when(flag, value)


def engine_of(explicit: Column, cloud: Column, js: Column, rule: Column) -> Column:
    """The rule's engine if it is known, else the explicit one, the cloud browser, the rendering one, the default."""
    return (
        F.when(rule.isin(*ENGINES), rule)
        .when(F.coalesce(explicit, F.lit("")) != "", explicit)
        .when(F.coalesce(cloud, F.lit(False)), "cloud-browser")
        .when(F.coalesce(js, F.lit(False)), "playwright")
        .otherwise("cheerio")
    )


def normal_rule(json: Column, url: Column) -> Column:
    """A generated rule with every field: selectors coerced, pages up to 500, a known engine, confidence 0 to 100."""
    fields = ", ".join(f"{f} struct<{SELECTOR.replace(' string', ':string')}>" for f in SELECTOR_FIELDS)
    raw = F.from_json(json, f"name string, description string, engine string, listUrl string, listPagination struct<type:string,selector:string,maxPage:double>, confidence double, notes array<string>, {fields}")
    host = F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1), F.lit("")), F.lit("unknown"))

    def text(c: Column, otherwise: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), otherwise)

    def coerced(s: Column) -> Column:
        return F.struct(text(s["type"], F.lit("css")).alias("type"), F.coalesce(s["value"], F.lit("")).alias("value"))

    page = raw["listPagination"]
    return F.struct(
        text(raw["name"], F.concat(host, F.lit(" - 自动生成规则"))).alias("name"),
        text(raw["description"], F.lit("基于AI分析自动生成的采集规则")).alias("description"),
        F.when(raw["engine"].isin(*ENGINES), raw["engine"]).otherwise("cheerio").alias("engine"),
        text(raw["listUrl"], url).alias("listUrl"),
        F.struct(
            text(page["type"], F.lit("next")).alias("type"),
            F.coalesce(page["selector"], F.lit("")).alias("selector"),
            F.when(page["maxPage"].isNull(), 50).otherwise(F.least(page["maxPage"], F.lit(500.0)).cast("int")).alias("maxPage"),
        ).alias("listPagination"),
        *[coerced(raw[f]).alias(f) for f in SELECTOR_FIELDS],
        F.when(raw["confidence"].isNull(), 50).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw["confidence"] + 0.5))).cast("int")).alias("confidence"),
        F.coalesce(raw["notes"], F.array().cast("array<string>")).alias("notes"),
    )


#: HTTP codes after which another try may help.
RETRY_CODES = (408, 429, 500, 502, 503, 504)


def backoff(attempt: Column, base: int = 1000, most: int = 30_000, jitter: Column | None = None) -> Column:
    """Milliseconds before the next try: doubled each time up to a bound, times 0.5 to 1."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(float(most))) * (0.5 + 0.5 * (F.rand() if jitter is None else jitter))


def retryable(code: Column) -> Column:
    return code.isNull() | code.isin(*RETRY_CODES)
