"""A rule's run over stored pages: list pages, book pages, chapters, against rows that are stored already."""

from __future__ import annotations

import json

from foliant.functions import markup
from foliant.operators import catalogue, crawl, extract

HOST = "http://books.example"


def made(spark):
    def listing(*books, following=None):
        return "".join(f'<li><a href="/b/{b}">x</a></li>' for b in books) + (f'<a class=n href="/l/{following}">next</a>' if following else "")

    def book(title, *chapters):
        return f"<h1>{title}</h1><i>已完结</i><ol>" + "".join(f'<li><a href="/c/{c}">Part {c}</a></li>' for c in chapters) + "</ol>"

    rows = [("/l/1", listing(1, 2, following=2)), ("/l/2", listing(2, 3, following=3)), ("/l/3", listing(1, 2, following=4)), ("/l/4", listing(9))]
    rows += [("/b/1", book("One", 11, 12, 11)), ("/b/2", book("Two", 21)), ("/b/3", book("One", 31)), ("/b/9", book("Never read", 91))]
    rows += [(f"/c/{c}", f"<div id=c>Text of {c}\n广告</div>") for c in (11, 12, 21, 31)]
    return spark.createDataFrame([(HOST + u, h) for u, h in rows], "url string, html string")


RULE = {
    "listUrl": HOST + "/l/1",
    "listSelector": {"type": "css", "value": "li a"},
    "listPagination": json.dumps({"type": "next", "selector": "a.n", "maxPage": 10}),
    "bookTitleSelector": {"type": "css", "value": "h1"},
    "bookStatusSelector": {"type": "css", "value": "i"},
    "chapterListSelector": {"type": "css", "value": "ol li"},
    "chapterLinkSelector": {"type": "css", "value": "a"},
    "chapterTitleSelector": {"type": "css", "value": "a"},
    "contentSelector": {"type": "css", "value": "#c"},
    "dedupMode": "both",
}


def test_run(spark):
    books = spark.createDataFrame([("id2", HOST + "/b/2", "Old title", 1)], "id string, url string, title string, updated_at int")
    chapters = spark.createDataFrame([(HOST + "/b/1", HOST + "/c/12", "Part 12")], "book_url string, url string, title string")
    found, fresh = extract.run_rule(RULE, made(spark), books, chapters)
    got = {r["url"]: (r["title"], r["status"], r["match"]) for r in found.collect()}
    assert got == {HOST + "/b/1": ("One", "completed", None), HOST + "/b/2": ("Two", "completed", "id2")}, "the third has the first's title; page 4 is not read"
    assert {r["url"]: (r["title"], r["sort_order"], r["content"]) for r in fresh.collect()} == {HOST + "/c/11": ("Part 11", 1, "Text of 11"), HOST + "/c/21": ("Part 21", 1, "Text of 21")}


def test_rules_without_usable_selectors(spark):
    assert extract.parsed(None) is None and extract.parsed("{") is None and extract.parsed('{"type": "sql", "value": "x"}') is None and extract.parsed({"type": "css", "value": " "}) is None
    df = spark.createDataFrame([("<h1>x</h1>", None)], "html string, url string")
    row = df.select(*[c.alias(n) for n, c in extract.book_columns({"bookTitleSelector": {"type": "css", "value": "h1"}}, df.html, df.url).items()]).first()
    assert (row["title"], row["author"], row["status"], row["chapters"]) == ("x", "", "ongoing", [])


def test_seeds_and_limits(spark):
    stored = spark.createDataFrame([("a",)], "name string")
    seeds = [{"name": "a", "config": "{}"}, {"name": "b", "config": "{}"}]
    assert [r["name"] for r in catalogue.seeded(spark, seeds, "name string, config string", stored, "name").collect()] == ["b"]
    ids = spark.range(30)
    assert [catalogue.limited(ids, n, ids.id).count() for n in (None, "x", 0, -3, "5", 9999)] == [20, 20, 20, 1, 5, 30]
    assert catalogue.filled(spark.createDataFrame([(1, None), (1, 2)], "a int, b int"), "a", "b").count() == 1


def test_contents_over_pages(spark):
    page = lambda text, following=None: f"<h2>{text} title</h2><p>{text}</p>" + (f'<a class=n href="{following}">more</a>' if following else "")
    rows = [("/a", page("a0", "/a1")), ("/a1", page("", "/a2")), ("/a2", page("a2", "/a")), ("/b", page("b0", "/gone")), ("/d", page("d0")), ("/e", page("e0", "/e"))]
    pages = spark.createDataFrame([(HOST + u, h) for u, h in rows], "url string, html string")
    starts = spark.createDataFrame([(HOST + u,) for u in ("/a", "/b", "/c", "/d", "/e", "/d")], "url string")
    read = lambda most: {r["url"].removeprefix(HOST): tuple(r)[1:] for r in crawl.read_contents(starts, pages, ("css", "p"), ("css", "h2"), "next", "a.n", most).collect()}
    assert read(100) == {"/a": ("a0 title", "a0\n\na2", 3, True), "/b": ("b0 title", "b0", 2, False), "/c": ("", "", 1, False), "/d": ("d0 title", "d0", 1, True), "/e": ("e0 title", "e0", 1, True)}
    assert read(1)["/a"] == ("a0 title", "a0", 1, True) and read(2)["/a"][2] == 2 and read(None)["/b"][3]


def test_outcomes_of_a_pass(spark):
    pages = made(spark).unionByName(spark.createDataFrame([(HOST + "/l/1", '<li><a href="/b/1">x</a></li><li><a href="/b/2">x</a></li><li><a href="/b/4">x</a></li><a class=n href="/l/2">n</a>')], "url string, html string"))
    stored = spark.createDataFrame([("id2", HOST + "/b/2", "Two volumes", "a", "d", 1), ("id1", HOST + "/b/1", "Unrelated", "a", "d", 2)], "id string, url string, title string, author string, description string, updated_at int")
    chapters = spark.createDataFrame([(HOST + "/b/1", HOST + "/c/12", "Part 12")], "book_url string, url string, title string")
    done = extract.run_pass(RULE, pages, stored, chapters)
    assert {r["url"].removeprefix(HOST): (r["outcome"], r["match"]) for r in done.books.collect()} == {
        "/b/1": ("new", None), "/b/2": ("existing", "id2"), "/b/3": ("skipped", None), "/b/4": ("failed", None),
    }, "the stored book with the first's address doesn't contain its title"
    assert done.counts().first().asDict() == {"total_books": 2, "new_books": 1, "skipped_books": 1, "failed_books": 1, "new_chapters": 2, "skipped_chapters": 1, "failed_chapters": 0}


def test_source_is_as_the_page_has_it():
    page = "<article>\n<p>a<p>b &lt;\n<h1 class=x> a &quot;b&quot; &amp;&am </h1><br/><li>one<li>two &#65;<i>x</i></article>"
    got = {s: markup.source(page, "css", s) for s in ("h1", "p", "p:nth-child(2)", "li", "li:last-child", "i", "br", "b")}
    assert got == {"h1": "a &quot;b&quot; &amp;&am", "p": "a", "p:nth-child(2)": "b &lt;", "li": "one", "li:last-child": "two &#65;<i>x</i>", "i": "x", "br": "", "b": ""}
    assert markup.source("<b>open &amp;", "css", "b") == "open &amp;" and markup.source(None, "css", "b") == ""


def test_book_fields_by_source(spark):
    df = spark.createDataFrame([("<title>a &quot;b&quot; &amp;&am</title>", "u")], "html string, url string")
    rule = {"bookTitleSelector": {"type": "css", "value": "title"}}
    assert df.select(extract.book_columns(rule, df.html, df.url, sources=("title",))["title"]).first()[0] == "a &quot;b&quot; &amp;&am"
