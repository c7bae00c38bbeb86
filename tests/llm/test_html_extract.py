from __future__ import annotations

import random
import time

import pytest

from foliant.llm import html_extract as x

from .cases import clashing

P1 = "The first paragraph is long enough, with commas, clauses, and words that make it an article."
P2 = "The second paragraph goes on, as articles do, for a good while, and then it stops here."
FRAME = "<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Menu one</a></li></ul></nav>{}<footer>Foot text, all rights reserved</footer></body></html>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (FRAME.format(f"<article><h1>Head</h1><p>{P1}</p><p>{P2}</p></article>"), f"Head {P1} {P2}"),
        (FRAME.format(f"<article><p><b>{P1}<br><p>{P2}</article>"), f"{P1} {P2}"),
        (FRAME.format(f"<div class=content><p>{P1}</p><div class='ad'>Buy now, cheap, fast, good</div><p>{P2}</p></div>"), f"{P1} {P2}"),
        (FRAME.format(f"<div id=main><p>{P1}</p><p>{P2}</p></div><div id=comments><p>A reader says, at length, that this is wrong, very wrong.</p></div>"), f"{P1} {P2}"),
        (FRAME.format(f"<div id=main><p>{P1}</p><script>var t='</p>';</script><form><p>Sign up, please</p></form></div><div class=sidebar><p>{P2}</p></div>"), P1),
        (FRAME.format(f"<article><p>{P1} 1 &lt; 2 &amp;&eacute;&#x41;</p>\n\n<p>a\n b\t c &copy; {P2}</p></article>"), f"{P1} 1 < 2 &éA a b c © {P2}"),
        ("plain text, no markup", "plain text, no markup"),
        ("<p>one</p><p>two</p>", "one two"),
        ("<!-- only a comment -->", ""),
        ("<nav><a href=/x>menu</a></nav>", ""),
    ],
)
def test_extract(page, text):
    assert x.extract(page) == text


@pytest.mark.parametrize("page", ["<", "<p", "<div><div><div>", "</p></div>", "<a href='x", "<![CDATA[x", "<script>never closed", "<p>" * 3000 + "deep", "<div>" * 3000 + "deep", "&#xFFFFFFFF;&bogus;"])
def test_broken_markup(page):
    assert isinstance(x.extract(page), str)


def test_link_density_discounts():
    links = "".join(f"<p><a href=/{i}>{P1}</a></p>" for i in range(6))
    assert x.extract(f"<body><div>{links}</div><div><p>{P1}</p><p>{P2}</p></div></body>") == f"{P1} {P2}"


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", FRAME.format(f"<article><p>{P1}</p></article>")), (None, "u", "<p>x</p>")]
    rows += [(5, "u", FRAME.format("<article>" + f"<p>{P1}</p>" * 5000 + "</article>"))] * 2
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = x.main_text(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[3] == P1 and {r["page_id"]: r["text"] for r in got}[1] == ""
    assert {r["n_chars"] for r in got if r["page_id"] == 5} == {5000 * (len(P1) + 1) - 1}
    assert x.main_text(pages.limit(0)).count() == 0


LONG = "".join(f"<p>{P1}</p>" for _ in range(20))
KEPT = " ".join([P1] * 20)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>Head</h1><section>{LONG}</section><section><p>Closing words</p></section></article>", f"Head {KEPT} Closing words"),
        (f"<main><div><div>{LONG}</div><ul><li>one</li></ul><table><tr><td>cell</td></tr></table><h3>End</h3></div></main>", f"{KEPT} one cell End"),
        (f"<div><div>{LONG}</div><div><p>Closing words</p></div><pre>code</pre></div>", f"{KEPT} Closing words code"),
        (f"<article><section>{LONG}</section><div class=related><p>{P2}</p></div><section><p>Closing words</p></section></article>", f"{KEPT} Closing words"),
    ],
)
def test_nested_sections_are_whole(page, text):
    assert x.extract(FRAME.format(page)) == text


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        (f"<header><h1>Head</h1><span>Share this</span></header>{LONG}", f"Head {KEPT}"),
        (f"{LONG}<div class=tools>{LONG}</div>", f"{KEPT} {KEPT}"),
        (f"{LONG}<div class=tools><a href=/p>Print</a> Save</div>", KEPT),
        (f"{LONG}<section class=left-side>{LONG}</section>", f"{KEPT} {KEPT}"),
        (f"{LONG}<section class='side ads'>{LONG}</section>", KEPT),
        (f"{LONG}<div class=comments>{LONG}</div>", KEPT),
        (f"{LONG}<p class=alert>Mind the cookies</p>", KEPT),
    ],
)
def test_names_of_furniture_in_an_article(inside, text):
    assert x.extract(FRAME.format(f"<article>{inside}</article>")) == text


@pytest.mark.parametrize("names", ["blog-share-post", "story side", "page-header main", "tag-article", "widget post", "social-science", "tools", "search-results"])
def test_names_of_furniture_on_a_container(names):
    assert x.extract(FRAME.format(f"<div class='{names}'>{LONG}</div><div><p>Short.</p></div>")) == KEPT
    assert x.extract(FRAME.format(f"<div><div class='{names}'><p>{P2}</p></div><div>{LONG}</div></div>")) == KEPT


@pytest.mark.parametrize("names", ["comments", "sidebar", "related", "newsletter", "disqus", "ad"])
def test_names_that_no_article_has(names):
    assert x.extract(FRAME.format(f"<div><p>{P1}</p><p>{P2}</p></div><div class='{names}'>{LONG}</div>")) == f"{P1} {P2}"


def test_formulas_and_objects_stay():
    inside = f"<p>{P1} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math></p><object data=a.pdf><p>{P2}</p></object><noscript>Turn scripts on</noscript>"
    assert x.extract(FRAME.format(f"<article>{inside}</article>")) == f"{P1} x=2 {P2}"


def test_time_is_linear_in_nested_names():
    def seconds(n: int) -> float:
        page, began = "<article>" + "<div class=tools>" * n + f"<p>{P1}</p>" * 4000 + "</div>" * n + "</article>", time.perf_counter()
        assert len(x.extract(page)) > 300_000
        return time.perf_counter() - began

    seconds(5)
    assert seconds(500) < 4 * max(seconds(50), 0.1)


@pytest.mark.parametrize("unit", ["<a ", "<b>x</i>", "<div>", "<b>", "<i><div></i>", "<li>", "<td>", "<a href='", '<a href="x', "<p><b>", "<!-- ", "</b>", "<ul><li><b>"])
def test_time_is_linear_in_broken_pages(unit):
    def seconds(n: int) -> float:
        page, began = unit * n + "text", time.perf_counter()
        x.extract(page)
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)


def made_page(rng):
    """A page of known parts, and the text of those that belong to the article."""

    def sentence():
        return " ".join(rng.choice(["stone", "river", "of", "the", "and", "walks", "green", "över", "naïve"]) for _ in range(rng.randint(6, 25))).capitalize() + rng.choice([".", ", or not.", "?"])

    kept, inner = [], []
    for _ in range(rng.randint(3, 12)):
        kind = rng.random()
        text = " ".join(sentence() for _ in range(rng.randint(1, 4)))
        if kind < 0.6:
            inner.append(f"<p>{text}" + "</p>" * rng.randint(0, 1))
            kept.append(text)
        elif kind < 0.7:
            inner.append(f"<blockquote><p>{text}</p></blockquote>")
            kept.append(text)
        elif kind < 0.8:
            inner.append(f"<ul><li>{text}</ul>")
            kept.append(text)
        elif kind < 0.9:
            inner.append(f"<div class='{rng.choice(['ad', 'share', 'related', 'newsletter'])}'><p>{text}</p></div>")
        else:
            inner.append(f"<script>{text}</script><style>{text}</style><!-- {text} -->")
    inner.insert(0, f"<p>{P1}</p>")
    kept.insert(0, P1)
    return FRAME.format(f"<{'article'}><h1>Head line</h1>{''.join(inner)}</article><aside><p>{P2}</p></aside><div class=comments><p>{P2}</p></div>"), " ".join(["Head line", *kept])


def test_labelled_pages():
    """Exact text of 200 pages built from labelled parts."""
    rng = random.Random(8)
    pages = [made_page(rng) for _ in range(200)]
    assert [x.extract(p) for p, _ in pages] == [t for _, t in pages]
