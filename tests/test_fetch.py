from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant.sources import fetch

SITE = {
    "http://a.example/1": (200, {"content-type": "text/html"}, "﻿one"),
    "http://a.example/2": (301, {"location": "/1"}, ""),
    "http://a.example/3": (302, {"location": "http://b.example/x"}, ""),
    "http://b.example/x": (200, {}, "x"),
    "http://a.example/4": (302, {"location": "http://169.254.169.254/latest"}, ""),
    "http://a.example/5": (302, {"location": "/6"}, ""),
    "http://a.example/6": (302, {"location": "/5"}, ""),
    "http://a.example/7": (302, {}, ""),
    "http://a.example/8": (404, {}, "gone"),
    "http://a.example/9": (200, {"content-type": "application/pdf"}, "%PDF"),
    "http://a.example/10": (200, {"content-type": "application/json"}, "{}"),
    "http://a.example/11": (200, {"content-type": "text/html"}, "x" * (fetch.MOST_CHARS + 1)),
    **{f"http://c.example/{n}": (302, {"location": f"/{n + 1}"}, "") for n in range(6)},
    "http://c.example/6": (200, {}, "end"),
}
WANT = {
    "http://a.example/1": ("one", "http://a.example/1", 0, None), "http://a.example/2": ("one", "http://a.example/1", 1, None), "http://a.example/3": ("x", "http://b.example/x", 1, None),
    "http://a.example/4": (None, "http://169.254.169.254/latest", 1, "redirect not allowed"), "http://a.example/5": (None, "http://a.example/5", 2, "redirect loop"),
    "http://a.example/7": (None, "http://a.example/7", 0, "HTTP 302"), "http://a.example/8": (None, "http://a.example/8", 0, "HTTP 404"),
    "http://a.example/9": (None, "http://a.example/9", 0, "content type application/pdf"), "http://a.example/10": ("{}", "http://a.example/10", 0, None),
    "http://a.example/11": (None, "http://a.example/11", 0, "body too large"), "http://c.example/0": (None, "http://c.example/5", 5, "HTTP 302"), "http://c.example/1": ("end", "http://c.example/6", 5, None),
    "http://localhost/": (None, "http://localhost/", 0, "address not allowed"), "ftp://a.example/": (None, "ftp://a.example/", 0, "address not allowed"),
}


def told(df):
    return {r["url"]: (r["html"], r["final_url"], r["n_redirects"], r["error"]) for r in df.collect()}


@pytest.mark.parametrize("how", ("stored", "asking"))
def test_rules_of_a_page(spark, how):
    site = dict(SITE)
    asked = spark.createDataFrame([(u,) for u in WANT] + [("http://a.example/1",), (None,)], "url string")
    if how == "stored":
        rows = [(u, s, h.get("location"), h.get("content-type"), b) for u, (s, h, b) in site.items()]
        ask = fetch.stored(spark.createDataFrame(rows, "url string, status int, location string, content_type string, body string"))
    else:
        ask = fetch.asking(lambda u: site[u], partitions=3, retries=0)
    assert told(fetch.fetch_pages(asked, ask)) == WANT
    missing = fetch.fetch_pages(spark.createDataFrame([("http://z.example/",)], "url string"), ask).first()
    assert missing["html"] is None and missing["error"] in ("no response", "KeyError: 'http://z.example/'")


def test_rounds_carry_no_bodies(spark):
    rows = [("a", 302, "b", None, "x"), ("a", 302, "b", None, "w"), ("b", 200, None, "image/png", "z"), ("b", 200, None, "text/html", "y"), ("b", 404, None, None, "a"), ("c", None, None, None, "n")]
    ask = fetch.stored(spark.createDataFrame(rows, "url string, status int, location string, content_type string, body string"))
    got = ask(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "current string"))
    assert {r["current"]: (r["status"], r["location"], r["body"], r["failure"]) for r in got.collect()} == {"a": (302, "b", None, None), "b": (200, None, None, None), "c": (None, None, None, None), "d": (None, None, None, "no response")}
    ended = ask.bodies(got.withColumn("error", F.lit(None).cast("string")))
    assert {r["current"]: (r["content_type"], r["body"]) for r in ended.collect()} == {"a": (None, None), "b": ("text/html", "y"), "c": (None, "n"), "d": (None, None)}


def test_retries():
    waits, left = [], [503, 500, None, 200]

    def flaky(url):
        status = left.pop(0)
        if status is None:
            raise ConnectionError("reset")
        return status, {}, "page"

    assert fetch.attempts("u", flaky, 3, 1.0, 15.0, waits.append)[1] == 200
    assert all(0.5 * 2**n <= w <= 2**n for n, w in enumerate(waits)) and len(waits) == 3
    for status, tries in ((404, 1), (503, 4)):
        calls = []
        got = fetch.attempts("u", lambda u, s=status, c=calls: (c.append(u), s, {}, "")[1:], 3, 0.0, 0.0, lambda w: None)
        assert got[1] == status and len(calls) == tries
    assert fetch.attempts("u", lambda u: 1 / 0, 1, 0.0, 0.0, lambda w: None)[5].startswith("ZeroDivisionError")


def test_a_host_is_one_task(spark):
    from pyspark.sql import functions as F

    urls = [(f"http://h{i % 7}.example/{i}",) for i in range(140)]

    def who(url):
        from pyspark import TaskContext

        return 200, {}, str(TaskContext.get().partitionId())

    got = fetch.asking(who, partitions=5)(spark.createDataFrame(urls, "current string"))
    by_host = got.groupBy(F.regexp_extract("current", "//([^/]*)", 1).alias("h")).agg(F.count_distinct("body").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert all(r["n"] == 1 and r["rows"] == 20 for r in by_host) and len(by_host) == 7
