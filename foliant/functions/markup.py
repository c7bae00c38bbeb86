"""HTML as rows: selectors, link lists, cleaning. A small tree per page inside Arrow-batched functions; Spark deals the pages."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from foliant.functions import xpath
from foliant.functions.text import tester_regex, usable_regex
from foliant.functions.urls import _resolve

# Fixed lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IMPLIED = (
    (("li",), frozenset({"ul", "ol", "menu"})), (("dt", "dd"), frozenset({"dl"})), (("td", "th"), frozenset({"tr", "table"})),
    (("tr",), frozenset({"table", "tbody", "thead", "tfoot"})), (("option",), frozenset({"select"})),
)
# Fixed lists of what cleaning removes.
SCRIPTS = "script, style, iframe, noscript, object, embed, applet"
AD_SELECTORS = (
    '[class*="ad"]', '[class*="Ad"]', '[class*="AD"]', '[class*="advert"]', '[class*="sponsor"]', '[class*="promo"]', '[class*="banner"]', '[class*="popup"]',
    '[class*="modal"]', '[class*="recommend"]', '[class*="tuijian"]', '[class*="guanggao"]', '[id*="ad"]', '[id*="Ad"]', '[id*="AD"]', '[id*="advert"]',
    '[id*="sponsor"]', '[id*="promo"]', '[id*="banner"]', '[id*="popup"]', '[id*="guanggao"]', '[class*="share"]', '[class*="social"]', '[id*="share"]', '[id*="social"]',
)


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], up: Element | None) -> None:
        self.tag, self.attrs, self.up, self.parts = tag, attrs, up, []

    def _below(self) -> Iterator[Element | str]:
        """Elements and texts below in page order, however deep."""
        stack = [*reversed(self.parts)]
        while stack:
            p = stack.pop()
            yield p
            if isinstance(p, Element):
                stack.extend(reversed(p.parts))

    def walk(self) -> Iterator[Element]:
        return (p for p in self._below() if isinstance(p, Element))

    def text(self) -> str:
        return "".join(p for p in self._below() if isinstance(p, str))

    def inner(self) -> str:
        out: list[str] = []
        stack: list[Element | str | tuple[str]] = [*reversed(self.parts)]
        while stack:
            p = stack.pop()
            if isinstance(p, tuple):
                out.append(p[0])
            elif isinstance(p, str):
                out.append(entities.escape(p, quote=False))
            else:
                attrs = "".join(f' {k}="{entities.escape(v)}"' for k, v in p.attrs.items())
                out.append(f"<{p.tag}{attrs}>")
                if p.tag not in VOID:
                    stack += [(f"</{p.tag}>",), *reversed(p.parts)]
        return "".join(out)

    def remove(self) -> None:
        self.up.parts = [p for p in self.up.parts if p is not self]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("#page", {}, None)

    def _close(self, tag: str) -> None:
        node = self.here
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.here = node.up

    def _leave(self, tags: tuple[str, ...], within: frozenset) -> None:
        """Close the nearest of some elements, unless one that bounds them comes first."""
        node = self.here
        while node.up is not None and node.tag not in within:
            if node.tag in tags:
                self.here = node.up
                return
            node = node.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._leave(("p",), CLOSES_P - {"p"} | {"td", "th", "li", "dd", "body"})
        for tags, within in IMPLIED:
            if tag in tags:
                self._leave(tags, within)
        node = Element(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.parts.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.here = self.here.up

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.here.parts.append(data)


class _Located(_Builder):
    """Keeps where in the page each element's content begins and ends (`begins`, `ends`)."""

    def __init__(self, page: str) -> None:
        super().__init__()
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self.root.begins, self.root.ends = 0, len(page)

    def _at(self) -> int:
        line, offset = self.getpos()
        return self.lines[line - 1] + offset

    def _end(self, before: Element, after: Element | None) -> None:
        while before is not after and before is not self.root:
            before.ends = self._at()
            before = before.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        before = self.here
        super().handle_starttag(tag, attrs)
        node = self.here if tag not in VOID else self.here.parts[-1]
        node.begins = self._at() + len(self.get_starttag_text())
        node.ends = node.begins if tag in VOID else self.root.ends
        if node.up is not before:
            self._end(before, node.up)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        super().handle_startendtag(tag, attrs)
        node = self.here.parts[-1]
        node.ends = node.begins

    def handle_endtag(self, tag: str) -> None:
        before = self.here
        super().handle_endtag(tag)
        if self.here is not before:
            self._end(before, self.here)


def parse(page: str | None, located: bool = False) -> Element:
    b = _Located(page or "") if located else _Builder()
    b.feed(page or "")
    b.close()
    return b.root


# One compound selector: a tag or *, then #id, .class, [attr...], :contains(), :first-child, :nth-child(n).
PART = re.compile(r"""#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:"((?:\\.|[^"])*)"|'((?:\\.|[^'])*)'|([^\]\s]+))\s*)?\]|:contains\(\s*["']?(.*?)["']?\s*\)|:(first-child|last-child)|:nth-child\((\d+)\)""")
HEAD = re.compile(r"\*|[a-zA-Z][\w-]*")
TESTS: dict[str, Callable[[str, str], bool]] = {
    "=": str.__eq__, "*=": lambda a, v: v != "" and v in a, "^=": lambda a, v: v != "" and a.startswith(v),
    "$=": lambda a, v: v != "" and a.endswith(v), "~=": lambda a, v: v in a.split(), "|=": lambda a, v: a == v or a.startswith(v + "-"),
}


def _has(name: str, op: str | None, value: str) -> Callable[[Element], bool]:
    return (lambda e: name in e.attrs) if op is None else (lambda e: name in e.attrs and TESTS[op](e.attrs[name], value))


def _nth(e: Element) -> tuple[int, int]:
    own = [p for p in e.up.parts if isinstance(p, Element)]
    return own.index(e) + 1, len(own)


def _compound(text: str) -> Callable[[Element], bool]:
    tests: list[Callable[[Element], bool]] = []
    at = 0
    if m := HEAD.match(text):
        at = m.end()
        if m[0] != "*":
            tests.append(lambda e, tag=m[0].lower(): e.tag == tag)
    while at < len(text):
        m = PART.match(text, at)
        if not m:
            raise ValueError(f"not a selector: {text!r}")
        at = m.end()
        if m[1] or m[2]:
            tests.append(_has("id", "=", m[1]) if m[1] else _has("class", "~=", m[2]))
        elif m[3]:
            tests.append(_has(m[3].lower(), m[4], re.sub(r"\\(.)", r"\1", next((v for v in m.group(5, 6, 7) if v is not None), ""))))
        elif m[9]:
            tests.append(lambda e, last=m[9] == "last-child": (n := _nth(e))[0] == (n[1] if last else 1))
        elif m[10]:
            tests.append(lambda e, n=int(m[10]): _nth(e)[0] == n)
        else:
            tests.append(lambda e, v=m[8]: v in e.text())
    if not text:
        raise ValueError("an empty selector")
    return lambda e: all(t(e) for t in tests)


def compile_css(selector: str) -> Callable[[Element], bool]:
    """A test of an element within its page: lists, descendants and children of compound selectors."""
    choices = []
    for one in re.split(r",(?![^\[(]*[\])])", selector):
        steps = re.findall(r"\s*(>)\s*|((?:\[[^\]]*\]|\([^)]*\)|[^\s>])+)", one.strip())
        chain: list[tuple[Callable[[Element], bool], bool]] = []
        child = False
        for arrow, text in steps:
            if arrow:
                child = True
            else:
                chain.append((_compound(text), child))
                child = False
        if not chain:
            raise ValueError(f"not a selector: {selector!r}")
        choices.append(chain)

    def fits(e: Element | None, chain: list, at: int) -> bool:
        if e is None or e.up is None or not chain[at][0](e):
            return False
        if at == 0:
            return True
        if chain[at][1]:
            return fits(e.up, chain, at - 1)
        up = e.up
        while up is not None:
            if fits(up, chain, at - 1):
                return True
            up = up.up
        return False

    return lambda e: any(fits(e, c, len(c) - 1) for c in choices)


def select(root: Element, selector: str) -> list[Element]:
    test = compile_css(selector)
    return [e for e in root.walk() if test(e)]


def xpath_elements(root: Element, path: str) -> tuple[list[Element], str | None, bool]:
    """(elements, attribute, asks for text) of an XPath: those whose attribute or text it ends with, else its own elements. A path
    that ends with [@name] asks for that attribute as well."""
    found = xpath.nodes(root, path)
    attribute = next((part for _, part in found if isinstance(part, str)), None)
    text = any(isinstance(part, int) for _, part in found)
    if not attribute and not text and (m := re.search(r"\[@([\w-]+)\]$", path)):
        attribute = m[1].lower()
    return list({id(e): e for e, _ in found}.values()), attribute, text


def _elements(root: Element, kind: str, value: str) -> tuple[list[Element], str | None, bool]:
    try:
        return xpath_elements(root, value) if kind == "xpath" else (select(root, value), None, False)
    except (ValueError, RecursionError, TypeError):  # not a path: a wrong number of arguments, too deep
        return [], None, False


def _regex(page: str, pattern: str, flags: int = re.I) -> list[re.Match]:
    return list(re.finditer(pattern, page[:500_000], flags)) if usable_regex(pattern) else []


def _timed(text: str, pattern: str, most: int, seconds: float = 2.0) -> list[str]:
    """The first matches of a tester's expression; none if it is refused or takes too long."""
    if not tester_regex(pattern):
        return []
    try:
        return [m[0] for m in islice(regex.finditer(pattern, text, regex.S, timeout=seconds), most)]
    except (TimeoutError, regex.error):
        return []


def one(page: str | None, kind: str, value: str, root: Element | None = None) -> str:
    """A single field: a regex's first whole match; an attribute of the first element, else the text of all."""
    if kind == "regex":
        return next((m[0] for m in _regex(page or "", value)), "")
    found, attribute, text = _elements(root or parse(page), kind, value)
    if not found:
        return ""
    whole = "".join(e.text() for e in found).strip()
    if kind == "xpath":
        if text:
            return whole
        return found[0].attrs.get(attribute, "") if attribute else found[0].attrs.get("href") or found[0].attrs.get("src") or whole
    for name in ("href", "src"):
        if f"[{name}]" in value or value.endswith(name):
            return found[0].attrs.get(name, "")
    return whole


def source(page: str | None, kind: str, value: str, root: Element | None = None) -> str:
    """What stands in the first element as the page has it written, character references and markup included."""
    if kind == "regex":
        return one(page, kind, value)
    found = _elements(root or parse(page, located=True), kind, value)[0]
    return page[found[0].begins : found[0].ends].strip() if found else ""


def many(page: str | None, kind: str, value: str, root: Element | None = None) -> list[str]:
    """All values: whole matches, or of each element its link, its source or its text."""
    if kind == "regex":
        return [m[0] for m in _regex(page or "", value)]
    found, attribute, text = _elements(root or parse(page), kind, value)
    pick = (lambda e: e.text().strip()) if text else (lambda e: e.attrs.get(attribute)) if attribute else (lambda e: e.attrs.get("href") or e.attrs.get("src") or e.text().strip())
    return [v for v in map(pick, found) if v]


def links(page: str | None, base: str | None, list_: tuple[str, str], link: tuple[str, str], title: tuple[str, str], root: Element | None = None) -> list[dict[str, str]]:
    """(title, url) per list element; what the element lacks is looked up in the page; a regex gives its group 1."""
    root = root or parse(page)
    rows = select(root, "body") if list_[0] == "regex" else _elements(root, *list_)[0]

    def within(row: Element, kind: str, value: str, attribute: str | None) -> str:
        if kind == "regex":
            m = next(iter(_regex(row.inner(), value)), None)
            return (m[1] if m.re.groups and m[1] else m[0]) if m else ""
        found, own, _ = _elements(row, kind, value)
        found = found or _elements(root, kind, value)[0]
        if attribute:
            return found[0].attrs.get(own or attribute, "") if found else ""
        return "".join(e.text() for e in found).strip()

    out = []
    for row in rows:
        if url := within(row, *link, "href"):
            out.append({"title": within(row, *title, None), "url": _resolve(base, url)})
    return out


# Fixed words on links to the next page.
NEXT_WORDS = ("下一页", "next")


def next_link(page: str | None, base: str | None, how: str, selector: str, page_no: int, root: Element | None = None) -> str:
    """The address of the page after page_no (from 0), '' without one. `next` takes the first element of the selector; `page` the
    first that shows the next number, else the first that says so in words or as '>'."""
    try:
        found = select(root or parse(page), selector)
    except ValueError:
        return ""
    if how == "page":
        numbered = [e for e in found if str(page_no + 2) in e.text()]
        found = numbered or [e for e in found if (t := e.text().strip()) == ">" or any(w in t for w in NEXT_WORDS)]
    elif how != "next":
        return ""
    href = found[0].attrs.get("href", "") if found else ""
    return _resolve(base, href) if href else ""


def clean(page: str | None, remove_ads: bool = True, ad_patterns: tuple[str, ...] = (), removals: tuple[str, ...] = ()) -> str:
    """The text without scripts, adverts and removed elements; the line-wise part is left to Columns."""
    root = parse(page)
    choices = [SCRIPTS]
    if remove_ads:
        own = [p.replace("\\", "\\\\").replace('"', '\\"') for p in ad_patterns if not set(p) & set(",{}")]
        choices += [*AD_SELECTORS, *(f'[{a}*="{p}"]' for p in own for a in ("class", "id"))]
    for choice in [", ".join(choices), *removals]:
        try:
            for e in select(root, choice):
                e.remove()
        except ValueError:
            continue  # an expression that is no selector works on the text
    return root.text()


#: Pages that are taken out of an Arrow batch together.
SLICE = 128


def _of_pages(column, kind: str, arrow: pa.DataType, value: Callable[[str | None], object]):
    """A value of each page, slice by slice: only a slice's pages are Python's besides the batch, whatever the batch's size."""

    @F.arrow_udf(kind)
    def run(pages: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([value(p) for p in pages.slice(at, SLICE).to_pylist()], arrow) for at in range(0, max(len(pages), 1), SLICE)])

    return run(column)


def css_one(column, kind: str, value: str):
    return _of_pages(column, "string", pa.string(), lambda p: one(p, kind, value))


def css_source(column, kind: str, value: str):
    return _of_pages(column, "string", pa.string(), lambda p: source(p, kind, value))


def css_many(column, kind: str, value: str):
    return _of_pages(column, "array<string>", pa.list_(pa.string()), lambda p: many(p, kind, value))


def link_rows(column, base, list_: tuple[str, str], link: tuple[str, str], title: tuple[str, str]):
    @F.pandas_udf("array<struct<title:string,url:string>>")
    def run(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([links(p, b, list_, link, title) for p, b in zip(pages, bases, strict=True)])

    return run(column, base)


def rule_fields(column, base, fields: dict[str, tuple[str, str]], lists: dict[str, tuple[tuple[str, str], ...]] | None = None, sources: tuple[str, ...] = ()):
    """All fields and link lists of a rule as one struct; a page is parsed once. fields: name to (kind, value); lists: name to the
    selectors of the list, the link and the title; sources: the fields to give as the page has them written."""
    lists = lists or {}
    kinds = [f"{n}:string" for n in fields] + [f"{n}:array<struct<title:string,url:string>>" for n in lists]

    @F.pandas_udf(f"struct<{','.join(kinds)}>")
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        rows = []
        for p, b in zip(pages, bases, strict=True):
            root = parse(p, located=bool(sources))
            rows.append({n: (source if n in sources else one)(p, *s, root) for n, s in fields.items()} | {n: links(p, b, *s, root=root) for n, s in lists.items()})
        return pd.DataFrame(rows, columns=[*fields, *lists])

    return run(column, base)


def page_step(column, base, page_no, items: tuple[str, str], how: str | None, selector: str):
    """struct<items, next_url> of a list page: its values and the address of the page after it."""

    @F.pandas_udf("struct<items:array<string>,next_url:string>")
    def run(pages: pd.Series, bases: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = []
        for p, b, n in zip(pages, bases, numbers, strict=True):
            root = parse(p)
            rows.append((many(p, *items, root), next_link(p, b, how, selector, int(n), root) if how else ""))
        return pd.DataFrame(rows, columns=["items", "next_url"])

    return run(column, base, page_no)


def plain_text(column, remove_ads: bool = True, ad_patterns: tuple[str, ...] = (), removals: tuple[str, ...] = ()):
    return _of_pages(column, "string", pa.string(), lambda p: clean(p, remove_ads, ad_patterns, removals))


def inspect(column, kind: str, value: str, most: int = 100):
    """The selector tester: up to 100 matches with tag, text and attributes, each cut to 100 characters."""

    def rows(page: str | None) -> list[dict]:
        if kind == "regex":
            body = next(iter(select(parse(page), "body")), parse(page)).text()[:100_000]
            return [{"at": i, "tag": "#text", "text": m[:100].strip(), "attrs": {}} for i, m in enumerate(_timed(body, value, most))]
        found = _elements(parse(page), kind, value)[0][:most]
        return [{"at": i, "tag": e.tag, "text": e.text().strip()[:100], "attrs": {k: v[:100] for k, v in e.attrs.items()}} for i, e in enumerate(found)]

    @F.pandas_udf("array<struct<at:int,tag:string,text:string,attrs:map<string,string>>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(rows)

    return run(column)


def suggest(column):
    """Selectors a page offers: headings, description, content, chapter lists, links and images."""
    offers = (
        ("title", "h1"), ("description", 'meta[name="description"]'), ("content", "article"), ("content", ".content"), ("content", "#content"),
        ("chapters", '[class*="chapter"]'), ("chapters", '[class*="list"]'), ("link", "a[href]"), ("image", "img[src]"),
    )

    @F.pandas_udf("array<struct<field:string,selector:string,matches:int>>")
    def run(pages: pd.Series) -> pd.Series:
        def rows(page: str | None) -> list[dict]:
            root = parse(page)
            found = ((field, css, len(select(root, css))) for field, css in offers)
            return [{"field": f, "selector": c, "matches": n} for f, c, n in found if n]

        return pages.map(rows)

    return run(column)
