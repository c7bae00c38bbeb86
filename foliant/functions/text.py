"""Text functions as Columns: cleaning, templates, paragraphs, labels. Lengths count code points."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACE = "[\\s\\u00a0\\u3000\\ufeff]"

# Fixed list: fragments of advertising lines.
AD_PATTERNS = (
    "推广", "广告", "下载APP", "下载app", "关注公众号", "关注我们", "扫码关注", "微信扫码", "微信公众号", "加入书签", "添加书签", "收藏本站",
    "本章未完", "请记住", "手机版阅读", "最新章节", "百度搜索", "本站网址", "请牢记", "天才一秒记住", "记住本站", "阅读请到", "如果您喜欢",
    "本章最新章节", "请访问", "天才一秒", "记住网址", "手机用户请浏览", "最新网址", "笔趣阁",
)
AD_REMAINDER = 10
REGEX_TEXT_LIMIT = 500_000


def ws_trim(c: Column) -> Column:
    """Trim all Unicode white space and the byte-order mark at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def sanitize(c: Column, most: int = 10_000) -> Column:
    """Without control characters (tab, line feed and return stay) and invisible format characters, trimmed, cut."""
    plain = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    plain = F.regexp_replace(plain, "[​-‏⁠-⁩﻿‪-‮]", "")
    return F.coalesce(F.substring(ws_trim(plain), 1, most), F.lit(""))


def drop_ad_lines(c: Column, patterns: tuple[str, ...] | list[str] = AD_PATTERNS) -> Column:
    """Drop a line that contains a pattern and has under ten characters besides it (the pattern in either case)."""

    def condemned(line: Column, p: str) -> Column:
        rest = ws_trim(F.regexp_replace(line, "(?iu)" + re.escape(p), ""))
        return line.contains(p) & (F.length(rest) < AD_REMAINDER)

    if not patterns:
        return c
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda line: ~reduce(Column.__or__, [condemned(line, p) for p in patterns])), "\n")


def normalize_space(c: Column) -> Column:
    for pattern, by in (("\r\n", "\n"), ("\t", "  "), ("[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, by)
    return ws_trim(c)


# Fixed shapes of expressions that are refused: nested or doubled quantifiers.
DANGEROUS = (
    r"\(\.[\*\+]\)\{", r"\([^)]*\{[\d,]+\}[^)]*\)\{", r"\(\[[^\]]*\]\+?\)\{", r"(\.\+|\.\*)\1", r"\([^)]*\+[^)]*\)\+", r"\([^)]*\*[^)]*\)\*", r"(\+|\*)\1",
)


# Fixed shapes that the selector tester refuses.
TESTER_DANGEROUS = (
    r"\((?:\([^)]*\)[+*]?\s*)+\+", r"(\.\+|\.\*)\1", r"\[[^\]]*\]\{(\d+),\1\}", r"(\+[+*]|\*[\+*])", r"\(\?[=!:]\([^)]*\)[+*]",
)


def tester_regex(pattern: str) -> bool:
    """Whether the selector tester runs an expression; the tester has a time limit besides."""
    return not any(re.search(d, pattern) for d in TESTER_DANGEROUS)


def usable_regex(pattern: str) -> bool:
    """Whether an expression of a user may run: no dangerous shape, and it compiles."""
    if any(re.search(d, pattern) for d in DANGEROUS):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    session = SparkSession.getActiveSession()
    if session is not None:  # on the driver, where the expression goes to the JVM's own engine
        try:
            session._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JError, PySparkException):
            return False
    return True


def remove_pattern(c: Column, pattern: str) -> Column:
    """Every match of a user's expression in either case removed; of a usable one only the first 500,000 characters
    remain. Refused expressions leave the text alone."""
    return F.regexp_replace(F.substring(c, 1, REGEX_TEXT_LIMIT), f"(?i){pattern}", "") if usable_regex(pattern) else c


def first_match(c: Column, pattern: str) -> Column:
    """The first whole match of a user's expression, null without one."""
    return F.get(all_matches(c, pattern), F.lit(0))


def all_matches(c: Column, pattern: str) -> Column:
    if not usable_regex(pattern):
        return F.array().cast("array<string>")
    return F.regexp_extract_all(F.substring(c, 1, REGEX_TEXT_LIMIT), F.lit(f"(?i){pattern}"), F.lit(0))


def clean_text(c: Column, ad_patterns: list[str] | None = None, remove_patterns: list[str] | None = None) -> Column:
    c = drop_ad_lines(c, [*AD_PATTERNS, *(ad_patterns or [])])
    return normalize_space(reduce(remove_pattern, remove_patterns or [], c))


def pattern_list(value: str | list | None) -> list[str]:
    """Patterns given as a list or as lines."""
    if isinstance(value, list):
        return [p for p in value if isinstance(p, str)]
    return [p.strip() for p in value.split("\n") if p.strip()] if isinstance(value, str) else []


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def status_of(c: Column) -> Column:
    """completed, hiatus or ongoing from a free status text, by its words."""

    def has(*words: str) -> Column:
        return reduce(Column.__or__, [c.contains(w) for w in words])

    return F.when(has("完", "结局", "end") | (c == "completed"), "completed").when(has("断", "暂停", "hiatus"), "hiatus").otherwise("ongoing")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Every {key} replaced, key after key, so a value may bring in a later key."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def fill_book_url(template: Column, url: Column) -> Column:
    """The first {bookUrl} of a template, or the address itself without a template."""
    at = F.locate("{bookUrl}", template)
    filled = F.concat(F.substring(template, F.lit(1), at - 1), url, F.substring(template, at + 9, F.length(template)))
    return F.when(F.coalesce(template, F.lit("")) == "", url).when(at == 0, template).otherwise(filled)


def file_name(c: Column) -> Column:
    return ws_trim(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"))


def cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def paragraphs(c: Column) -> Column:
    """Non-blank lines with their own spacing."""
    return F.filter(F.split(c, "\n", -1), lambda p: ws_trim(p) != "")


def page_title(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return ws_trim(F.regexp_replace(inner, "<[^>]+>", ""))


def contains_lower(c: Column, part: str) -> Column:
    """Whether a text holds a part, in either case."""
    return F.lower(c).contains(part.lower())


def prefixed(prefix: str, key: Column) -> Column:
    """An id with its kind in front."""
    return F.concat(F.lit(f"{prefix}_"), key.cast("string"))


def has_text(c: Column) -> Column:
    return F.length(ws_trim(F.coalesce(c, F.lit("")))) > 0


def is_hex_colour(c: Column) -> Column:
    return c.rlike("^#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$")


def is_dark(colour: Column) -> Column:
    """Weighted luminance of #rrggbb under the middle; false for other texts."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("int")
    return F.when(colour.rlike("^#[0-9a-fA-F]{6}$"), (299 * part(2) + 587 * part(4) + 114 * part(6)) / 1000 < 128).otherwise(F.lit(False))


def is_domain(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}$")


def is_identifier(c: Column) -> Column:
    return c.rlike("^[a-zA-Z0-9_-]+$")


def score_band(c: Column) -> Column:
    return F.when(c >= 80, "high").when(c >= 50, "medium").otherwise("low")


def elapsed(seconds: Column) -> Column:
    return F.when(seconds < 60, "now").when(seconds < 120, "a minute ago").otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit(" minutes ago")))


def day_part(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").otherwise("evening")


def toggle(items: Column, item: Column) -> Column:
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def safe_day(text: Column, otherwise: str = "—") -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd"), F.lit(otherwise))


def cookie_header(cookies: Column) -> Column:
    """name=value pairs of array<struct<name, value>> without control characters, joined by '; '."""
    plain = lambda x: F.regexp_replace(x, r"[\x00-\x1f\x7f]", "")
    named = F.filter(cookies, lambda k: F.coalesce(k["name"], F.lit("")) != "")
    return F.array_join(F.transform(named, lambda k: F.concat(plain(k["name"]), F.lit("="), plain(F.coalesce(k["value"], F.lit(""))))), "; ")


def confusion_block(lines: Column, seed: int, most: int = 2) -> Column:
    """One or two of the trimmed non-blank lines, shuffled by a seed."""
    usable = F.filter(F.transform(F.split(lines, "\n", -1), ws_trim), lambda x: x != "")
    return F.array_join(F.slice(F.shuffle(usable, F.lit(seed)), 1, most), "\n")
