"""Text, URL, rule and page functions on literal rows, with the edges the tables lack."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import markup, rules, text, urls
from foliant.sources import pages as sources


def values(spark, expression, *rows: tuple, schema: str = "x string"):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(expression).collect()]


def strings(spark, expression, *xs):
    return values(spark, expression, *[(x,) for x in xs])


def test_trim_and_sanitize(spark):
    assert strings(spark, text.ws_trim(F.col("x")), "　a b ﻿\n", "") == ["a b", ""]
    assert strings(spark, text.sanitize(F.col("x"), 3), " a\x00b​c\td ", None) == ["abc", ""]


def test_ad_lines_turn_on_what_is_left(spark):
    nine, ten = "广告" + "x" * 9, "广告" + "x" * 10
    assert strings(spark, text.drop_ad_lines(F.col("x")), f"{nine}\nkept\n{ten}", "plain", None) == [f"kept\n{ten}", "plain", None]


def test_ad_line_counts_either_case_as_the_pattern(spark):
    assert strings(spark, text.drop_ad_lines(F.col("x"), ["Buy"]), "Buy BUY buy now", "buy BUY") == ["", "buy BUY"]


def test_normalize_space(spark):
    assert strings(spark, text.normalize_space(F.col("x")), " a \t b\r\n \n\n\n c ") == ["a b\n\nc"]


def test_dangerous_expressions_leave_the_text(spark):
    assert not text.usable_regex("(a+)+") and not text.usable_regex("a++") and not text.usable_regex("(")
    assert strings(spark, text.remove_pattern(F.col("x"), "(a+)+"), "aab") == ["aab"]
    long = "a" * 500_001
    assert strings(spark, F.length(text.remove_pattern(F.col("x"), "b")), long) == [500_000]


def test_templates(spark):
    filled = text.fill_template(F.lit("{a}-{b}"), {"a": F.lit("{b}"), "b": F.lit("2")})
    assert strings(spark, filled, "") == ["2-2"]
    assert strings(spark, text.fill_book_url(F.col("x"), F.lit("U")), "{bookUrl}/l/{bookUrl}", None, "", "plain") == ["U/l/{bookUrl}", "U", "U", "plain"]


def test_status_and_paragraphs(spark):
    assert strings(spark, text.status_of(F.col("x")), "已完结", "pending", "暂停", "", "completed") == ["completed", "completed", "hiatus", "ongoing", "completed"]
    assert strings(spark, text.paragraphs(F.col("x")), "  a\n \n\nb ") == [["  a", "b "]]


def test_small_functions(spark):
    assert strings(spark, text.is_dark(F.col("x")), "#000000", "#ffffff", "#fff") == [True, False, False]
    assert strings(spark, text.file_name(F.col("x")), ' a/b:c*.txt ') == ["a_b_c_.txt"]
    assert strings(spark, text.cut(F.col("x"), 3), "abcd", "abc") == ["abc...", "abc"]
    assert strings(spark, text.safe_day(F.col("x")), "2024-02-03T04:05:06", "no") == ["2024-02-03", "—"]
    assert strings(spark, text.is_domain(F.col("x")), "a-b.example.org", "-a.org", "a") == [True, False, False]
    assert strings(spark, text.page_title(F.col("x")), "<title lang=x> a <b>c</b> </title>", "none") == ["a c", ""]


SAFE = {
    "https://example.com/x": True, "http://8.8.8.8": True, "http://172.32.0.1/": True, "http://172.16.0.1/": False, "http://127.0.0.1/": False,
    "http://169.254.169.254/": False, "http://localhost./": False, "http://a.internal/": False, "http://x.nip.io/": False, "http://0x7f.0.0.1/": False, "http://0177.0.0.1/": False,
    "http://2130706433/": False, "http://127.1/": False, "http://[::1]/": False, "http://[fe80::1]/": False, "http://[::ffff:10.0.0.1]/": False, "http://user@10.0.0.1:80/": False,
    "ftp://example.com/": False, "javascript:alert(1)": False, "": False, "http://240.0.0.1/": False, "http://[2001:db8::1]/": True,
}


def test_safe_urls(spark):
    assert dict(zip(SAFE, strings(spark, urls.is_safe_url(F.col("x")), *SAFE), strict=True)) == SAFE
    assert strings(spark, urls.is_safe_url(F.col("x")), None) == [False]


def test_resolution(spark):
    rows = [("http://A.com:80/x/y", "../z"), ("http://a.com", ""), (None, "rel"), ("http://a.com/b", "https://B.org:8443"), ("http://a.com", "http://[bad")]
    assert values(spark, urls.resolve_url(F.col("x"), F.col("y")), *rows, schema="x string, y string") == ["http://a.com/z", "http://a.com/", "rel", "https://b.org:8443/", "http://[bad"]


def test_paths_and_clients(spark):
    assert strings(spark, urls.is_save_path(F.col("x")), "/app/public/covers/a_1.webp", "/app/public/covers/../a.webp", "/app/public/covers/a.png", "/etc/a.webp") == [True, False, False, False]
    assert strings(spark, urls.client_address(F.lit(None).cast("string"), F.col("x")), "1.1.1.1, 2.2.2.2", None) == ["2.2.2.2", None]


def test_rules(spark):
    assert strings(spark, rules.selector(F.col("x")), ".plain", '{"type":"css","value":"a"}')[0] is None
    assert strings(spark, rules.integer(F.col("x"), 7, 1, 9), "12abc", "0", "x", None, "-3") == [9, 7, 7, 7, 1]
    errors = strings(spark, rules.selector_error(F.col("x"), True), None, "x", '{"type":"no","value":"a"}', '{"type":"css","value":" "}', '{"type":"css","value":"a"}')
    assert [e is None for e in errors] == [False, False, False, False, True]
    assert strings(spark, rules.fenced_json(F.col("x")), 'so:\n```json\n{"a":1}\n```', 'x {"a":2} y') == ['{"a":1}', '{"a":2}']
    rule = strings(spark, rules.normal_rule(F.col("x"), F.lit("https://h.org/l")), '{"engine":"?","confidence":170.4,"listSelector":{"value":"li"},"listPagination":{"maxPage":900}}', "junk")
    assert (rule[0]["engine"], rule[0]["confidence"], rule[0]["listSelector"]["type"], rule[0]["listPagination"]["maxPage"], rule[0]["listUrl"]) == ("cheerio", 100, "css", 500, "https://h.org/l")
    assert rule[1]["confidence"] == 50 and rule[1]["notes"] == [] and rule[1]["name"].startswith("h.org")
    low, high = rules.delays(F.lit("0"), F.lit("99999999"))
    assert strings(spark, F.struct(low, high), "")[0][:] == (1000, 60_000)
    assert strings(spark, rules.json_or(F.col("x"), "a long", F.struct(F.lit(5).cast("long").alias("a")))["a"], '{"a":1}', "{", None) == [1, 5, 5]


PAGE = """<html><body><div class='list'><p>x<ul><li><a href='/1'>One<li><a href="/2">Two &amp; <b>2</b></a></ul></div>
<img src=i.png><div id=c class="ad box">Ad</div><script>var a='<p>';</script><p>last</body>"""


def test_selectors_text_of_all_and_attribute_of_first():
    assert markup.one(PAGE, "css", "li a") == "OneTwo & 2" and len(markup.select(markup.parse(PAGE), "li")) == 2
    assert markup.one(PAGE, "css", "li a[href]") == "/1"
    assert markup.many(PAGE, "css", "div.list > ul > li a") == ["/1", "/2"]
    assert markup.many(PAGE, "xpath", "//li/a/@href") == ["/1", "/2"]
    assert markup.one(PAGE, "xpath", "//div[@id='c']/text()") == "Ad"
    assert markup.one(PAGE, "regex", "HREF='(/1)'") == "href='/1'"
    assert markup.many(PAGE, "css", "a:contains('Two')") == ["/2"]
    assert markup.many(PAGE, "css", "][") == [] and markup.one(None, "css", "a") == ""


def test_link_lists_fall_back_to_the_page_and_regex_gives_its_group():
    assert markup.links(PAGE, "http://h/", ("css", "li"), ("css", "a"), ("css", "b")) == [{"title": "2", "url": "http://h/1"}, {"title": "2", "url": "http://h/2"}]
    assert markup.links(PAGE, "http://h/", ("regex", "x"), ("regex", 'href="([^"]+)"'), ("regex", "none"))[0]["url"] == "http://h/1"


def test_cleaning_keeps_no_script_or_advert():
    plain = markup.clean(PAGE)
    assert "var a" not in plain and "Ad" not in plain and "last" in plain
    assert "Ad" in markup.clean(PAGE, remove_ads=False)
    assert "last" not in markup.clean(PAGE, removals=("p", "(["))


@given(st.text(alphabet="<>/abp =\"'&;!-", max_size=80))
def test_any_text_parses(page):
    markup.clean(page)


def test_page_sources(spark):
    assert strings(spark, sources.json_depth_ok(F.col("x"), 2), '{"a":{"b":1}}', '{"a":{"b":[1]}}', '"[[["') == [True, False, True]
    assert values(spark, sources.record_html(F.col("x")), ({"a": "<1>", "b": None},), schema="x map<string,string>") == ['<div class="a">&lt;1&gt;</div>']
    assert strings(spark, sources.provider_page(F.col("x")), '{"data":{"html":"<p>"}}')[0] == "<html><body><p></body></html>"

    class Fixed(sources.FetchedPages):
        fetch = staticmethod(lambda url: ("﻿<p>" + url, url, 200))

    spark.dataSource.register(Fixed)
    got = spark.read.format("fetched_pages").option("urls", "http://a/\nhttp://b/").load().orderBy("url").collect()
    assert [r["html"] for r in got] == ["<p>http://a/", "<p>http://b/"]
    with pytest.raises(Exception, match="fetch"):
        spark.dataSource.register(sources.FetchedPages)
        spark.read.format("fetched_pages").option("urls", "http://a/").load().collect()


def test_deep_and_unclosed_markup():
    from foliant.functions import markup

    deep = "<b>" * 5000 + "<a href=x>end</a>"
    assert markup.one(deep, "css", "a[href]") == "x"
    assert markup.clean(deep).endswith("end")
    assert markup.select(markup.parse(deep), "b")[0].inner().count("</b>") == 4999


def test_next_link():
    from foliant.functions import markup

    page = '<a class=p href=/2>2</a><a class=p href=/3>3</a><a class=p href=/n>下一页</a>'
    assert markup.next_link(page, "http://h.example/1", "next", "a.p", 0) == "http://h.example/2"
    assert markup.next_link(page, "http://h.example/1", "page", "a.p", 1) == "http://h.example/3"
    assert markup.next_link(page, "http://h.example/1", "page", "a.p", 7) == "http://h.example/n"
    assert markup.next_link(page, "http://h.example/1", "page", "a.q", 0) == ""
    assert markup.next_link(page, "http://h.example/1", "page", "a[", 0) == ""


def test_bodies_with_long_strings_and_many_keys(spark):
    from foliant.sources import pages

    bodies = [('"' + "x" * 20_000 + '\\""', True, True), ("[" * 21 + "1" + "]" * 21, False, True), ('{"a": {"b": 1, "c": 2, "d": 3}}', True, False), ("{", False, False), (None, False, False)]
    df = spark.createDataFrame([(i, b) for i, (b, _, _) in enumerate(bodies)], "i int, b string")
    got = {r["i"]: (r["d"], r["k"]) for r in df.select("i", pages.json_depth_ok(df.b).alias("d"), pages.json_keys_ok(df.b, 2).alias("k")).collect()}
    assert got == {i: (d, k) for i, (_, d, k) in enumerate(bodies)}


def test_expressions_that_java_refuses_leave_the_text(spark):
    from foliant.functions import text

    df = spark.createDataFrame([("banana",)], "t string")
    assert df.select(text.remove_pattern(df.t, "(?P<n>a)").alias("t")).first()["t"] == "banana"
    assert df.select(text.remove_pattern(df.t, "(?<n>a)").alias("t")).first()["t"] in ("bnn", "banana")


def test_page_functions_take_slices_of_a_batch(spark):
    from pyspark.sql import functions as F
    from pyspark.util import PythonEvalType

    from foliant.functions import markup

    n = 2 * markup.SLICE + 3
    html = F.when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("<script>x</script><b>t"), F.col("id").cast("string"), F.lit("</b>")))
    df = spark.range(0, n, 1, 1).select("id", html.alias("html")).select("id", markup.plain_text(F.col("html")).alias("t"), markup.css_many(F.col("html"), "css", "b").alias("many"))
    assert {r["id"]: (r["t"], r["many"]) for r in df.collect()} == {i: (("", []) if i % 50 == 0 else (f"t{i}", [f"t{i}"])) for i in range(n)}
    assert df.where("id < 0").collect() == [] and f"], {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in df._jdf.queryExecution().executedPlan().toString()
