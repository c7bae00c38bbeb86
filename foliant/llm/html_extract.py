"""HTML main-text extraction by tree scoring.

A page becomes a tree of elements (implied end tags and unclosed elements included). Paragraphs give points for their length and
commas to their parent and, by halves, to the ancestors above; an ancestor's sum is discounted by its link density and
adjusted by what its class and id say. If the best container lies inside of an article or main element, that element (the
innermost one) is kept whole, and so is a parent whose other children hold no furniture and few links; else the best container is
kept with those siblings that score well beside it or are plain running text. From the kept nodes, blocks that belong to the page rather than the article are dropped: menus,
headers, footers, sidebars, notices, adverts, forms, comments. A headed page keeps its h1 if it leads the container.

Within an article or main element, a header's headings stay, and a name that may stand on furniture as well as on a part of the article
(notice, tools, side) drops only what isn't running text. Elsewhere a block of such a name, or of one of sharing, stays if
it holds most of the page's text outside of links and furniture. Text of formulas and objects stays; what is meant for browsers without
scripts (noscript) goes with the scripts.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined in page order
by one space. Nothing is capped; a page is one row of a narrow stage.

Defined results: null and empty html give the empty text; a very long or broken page takes time in proportion to its length; an empty table
gives no rows; without any paragraph, the loose text of the best block is
taken, and the body's own text when nothing scores; ties go to the container that comes first; repeated rows are
extracted each; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import body

#: A tag without its end takes the rest of the page, so no part of a page is read again for another start.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
#: Deeper elements are laid beside each other at this depth, as browsers do; their text stays.
DEPTH = 512
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f\v\xa0 -    　]+")

# Fixed sets of HTML's own element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas noembed noframes annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "head", "html", "body", "legend"}
SAME_LEVEL = {
    "li": ("li", frozenset({"ul", "ol", "menu", "dir"})),
    "dt": ("dt dd", frozenset({"dl"})),
    "dd": ("dt dd", frozenset({"dl"})),
    "tr": ("tr td th", frozenset({"table"})),
    "td": ("td th", frozenset({"tr", "table"})),
    "th": ("td th", frozenset({"tr", "table"})),
    "option": ("option", frozenset({"select"})),
}
DROPPED = frozenset("nav header footer aside form button select input menu dialog fieldset head script style noscript template iframe svg".split())
PARAGRAPH = frozenset("p pre td blockquote li dd".split())

OFF = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline|comments?|commentlist|consent|cookies?|disqus|footer|footnotes|foot|header|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notices?|outbrain|pager|pagination|popup|promo\w*|related|remark|replies|reply|respond|rss|share|sharing|shoutbox|sidebar|side|skip|social|"
    r"sponsor\w*|subscribe|subscription|tags?|taboola|toolbar|tools|widgets?|alert|disclaimer|login|signup|search)(?:$|[\s_\d-])",
    re.I,
)
#: Names that also stand on parts of an article: there, running text of this many characters with few links stays.
SOFT_NAMES = "byline|foot|header|masthead|notices?|side|skip|tags?|toolbar|tools|widgets?|alert|disclaimer|search"
SOFT = re.compile(rf"(?:^|[\s_-])(?:{SOFT_NAMES})(?:$|[\s_\d-])", re.I)
#: Names that also stand on an article's container: elsewhere, such a block stays if it holds most of the page's unlinked text.
CONTAINER = re.compile(rf"(?:^|[\s_-])(?:{SOFT_NAMES}|share|sharing|social)(?:$|[\s_\d-])", re.I)
RUNNING = 240
GOOD = re.compile(r"article|body|content|entry|hentry|main|page|post|text|blog|story", re.I)
ROLES_OFF = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())


class Node:
    __slots__ = ("tag", "names", "role", "parts", "up", "score", "hidden", "depth", "inside", "chars", "links", "clear", "most", "off")

    def __init__(self, tag: str, up: Node | None, attrs: str = "") -> None:
        self.tag, self.up, self.names, self.role, self.hidden = tag, up, "", "", False
        self.depth = up.depth + 1 if up else 0
        self.inside = up is not None and (up.inside or up.tag in ("article", "main"))
        self.chars = self.links = self.clear = 0
        self.most = self.off = False
        self.parts: list[Node | str] = []
        self.score = 0.0
        if attrs and not attrs.isspace():
            for m in ATTR.finditer(attrs):
                name = m[1].lower()
                value = m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    self.names += " " + html.unescape(value)
                elif name == "role":
                    self.role = value.strip().lower()
                elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()) or (name == "aria-hidden" and value == "true"):
                    self.hidden = True

    def elements(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))


def parse(page: str) -> Node:
    """The tree. Walks up are at most DEPTH steps, and none for an end tag without its start, so the time is linear."""
    root = Node("#page", None)
    here, at, size = root, 0, len(page)
    opened: Counter = Counter()  # start tags by name that had no end tag yet

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            here.parts.append(page[at:])
            break
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at = m.end()
        if m["cdata"]:
            here.parts.append(html.escape(m["cdata"]))
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if not opened[tag]:
                continue
            opened[tag] -= 1
            node = here
            while node is not root and node.tag != tag:
                if tag not in BLOCK and node.tag in BLOCK:  # an inline end tag doesn't close a block
                    node = root
                    break
                node = node.up
            if node is not root:
                here = node.up
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag in CLOSES_P:
            node = here
            while node is not root and node.tag != "p" and node.tag not in BLOCK:
                node = node.up
            if node.tag == "p":
                here = node.up
        if tag in SAME_LEVEL:
            names, stops = SAME_LEVEL[tag]
            node, last = here, None
            while node is not root and node.tag not in stops:
                if node.tag in names.split():
                    last = node
                node = node.up
            if last is not None:
                here = last.up
        node = Node(tag, here, m["attrs"])
        here.parts.append(node)
        if tag not in VOID and not m["attrs"].endswith("/"):
            opened[tag] += 1
            if node.depth < DEPTH:
                here = node
    return root


def _fixed(node: Node) -> bool:
    """Whether a node's kind, role or state, or a name that no article has, makes it furniture whatever it holds."""
    if node.tag == "header" and not node.hidden and node.inside:
        return False
    if node.tag in DROPPED or node.hidden or node.role in ROLES_OFF:
        return True
    return _named_off(node) and bool(OFF.search((SOFT if node.inside else CONTAINER).sub(" ", node.names)))


def _named_off(node: Node) -> bool:
    return bool(node.names) and node.tag not in ("html", "body", "article", "main") and bool(OFF.search(node.names))


def _measure(root: Node) -> None:
    """Of each element, the characters below, those in links, those neither in links nor in fixed furniture, whether the
    latter are most of the page's, and whether it is the page's furniture rather than part of an article (off)."""
    order = list(root.elements())
    for node in reversed(order):  # children come before their parents
        for p in node.parts:
            if isinstance(p, str):
                size = len(SPACE.sub(" ", p).strip())
                node.chars += size
                node.clear += size
            else:
                node.chars += p.chars
                node.links += p.links
                node.clear += p.clear
        if node.tag == "a":
            node.links = node.chars
        node.off = _fixed(node)
        if node.tag == "a" or node.off:
            node.clear = 0
    for node in order:
        node.most = 2 * node.clear > root.clear
        if not node.off and node.tag != "header" and _named_off(node):
            node.off = not (node.chars >= RUNNING and node.links <= 0.2 * node.chars if node.inside else node.most)


def blocks(node: Node, keep_all: bool = False) -> list[str]:
    """The texts of the blocks below, furniture left out, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [*reversed(node.parts)]
    while stack:
        part = stack.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag in ("br", "hr"):
            run.append(" ")
        elif keep_all or not part.off:
            if part.tag in BLOCK:
                flush()
                stack.append(None)
            inner = part.parts if part.tag != "header" or keep_all else [n for n in part.elements() if n.tag in ("h1", "h2", "h3", "h4")]
            stack.extend(reversed(inner))
    flush()
    return out


def _own_text(node: Node) -> str:
    """A paragraph's text: its inline content, without nested blocks."""
    out, stack = [], [*reversed(node.parts)]
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            out.append(p)
        elif p.tag not in BLOCK:
            stack.extend(reversed(p.parts))
    return SPACE.sub(" ", "".join(out)).strip()


def _weight(node: Node) -> float:
    names = node.names
    return (25.0 if GOOD.search(names) else 0.0) - (25.0 if OFF.search(names) and not node.most else 0.0) + (25.0 if node.tag in ("article", "main") else 0.0)


def _whole(best: Node, furniture: set[int]) -> Node:
    """The innermost article or main element around the best container; without one, the outermost parent (below the
    body) reached while the other children are no furniture and under a quarter of their text is links."""
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            return up
        up = up.up
    while best.up is not None and best.up.tag in ("div", "section", "td"):
        others = [p for p in best.up.parts if isinstance(p, Node) and p is not best]
        chars, links = sum(p.chars for p in others), sum(p.links for p in others)
        if any(id(p) in furniture for p in others) or links > 0.25 * chars:
            break
        best = best.up
    return best


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _measure(root)
    furniture: set[int] = set()
    order: list[Node] = []
    for node in root.elements():
        if id(node.up) in furniture or (node.up is not None and node.off):
            furniture.add(id(node))
        else:
            order.append(node)
    candidates: dict[int, Node] = {}
    for node in order:
        if node.tag not in PARAGRAPH:
            continue
        text = _own_text(node)
        if not text:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)
        up, share = node.up, 1.0
        while up is not None and share > 0.1:
            if id(up) not in candidates:
                candidates[id(up)] = up
                up.score = _weight(up)
            up.score += points * share
            up, share = up.up, share / 2
    for node in candidates.values():
        node.score *= 1 - node.links / node.chars if node.chars else 0
    best = max(candidates.values(), key=lambda n: n.score, default=None)
    if best is None or best.score <= 0:
        bodies = [n for n in order if n.tag == "body"] or [root]
        return " ".join(blocks(bodies[0]))
    while best.tag not in ("article", "main", "body", "div", "section", "td", "#page") and best.up is not None:
        best = best.up
    best = _whole(best, furniture)
    if best.up is None or best.tag in ("body", "article", "main", "html"):
        return " ".join(blocks(best))
    bar, out = max(10.0, best.score * 0.2), []
    for part in best.up.parts:
        if not isinstance(part, Node) or id(part) in furniture:
            continue
        chars, links = part.chars, part.links
        density = links / chars if chars else 1.0
        running = part.tag == "p" and (chars > 80 and density < 0.25 or 0 < chars <= 80 and links == 0 and _own_text(part).endswith((".", "!", "?")))
        if part is best or (id(part) in candidates and part.score >= bar) or running or (part.tag in ("h1", "h2") and links == 0):
            own = Node("#kept", None)
            own.parts.append(part)
            out += blocks(own)
    return " ".join(out)


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column("html").to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    inputs = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body(column).alias("html"))
    return inputs.mapInArrow(run, "page_id long, url string, text string, n_chars long")
