from __future__ import annotations

import random
import xml.etree.ElementTree as ET

import pytest

from foliant.functions import markup, text, xpath

PAGE = """<html><body><ul id=u><p>x</p><li>one</li><p class="a b">y</p><li class=k><a href="/2" title=t>two</a> and</li><li>three<b>!</b></li></ul>
<div><ul><li>other</li></ul><span> a  b </span></div></body></html>"""


@pytest.mark.parametrize(("path", "want"), [
    ("//li[2]", ["two and"]), ("//ul/li[1]", ["one", "other"]), ("(//li)[1]", ["one"]), ("//ul[@id='u']/li[last()]", ["three!"]), ("//ul/*[2]", ["one"]), ("/html/body/ul/p[2]", ["y"]),
    ("//li[position() < 3]", ["one", "two and", "other"]), ("//li[b]", ["three!"]), ("//li[a/@href='/2']", ["two and"]), ("//li[not(@class) and not(b)]", ["one", "other"]),
    ("//li[contains(., 'two')]/a", ["two"]), ("//p[contains(@class, 'b')]", ["y"]), ("//p[starts-with(@class, 'a ')]", ["y"]), ("//span[normalize-space()='a b']", [" a  b "]),
    ("//a/..", ["two and"]), ("//a/ancestor::ul/@id", ["u"]), ("//li[@class]/following-sibling::li", ["three!"]), ("//li[@class]/preceding-sibling::li", ["one"]),
    ("//p[2]/following-sibling::*[1]", ["two and"]), ("//li[@class='k']/text()", [" and"]), ("//p | //b", ["x", "y", "!"]), ("//li[count(*) = 1][2]", ["three!"]), ("//li[text()='one' or text()='other']", ["one", "other"]),
    ("//ul[count(li) > 2]/p[1]", ["x"]), ("//*[@title]", ["two"]), ("//li/a/@*", ["/2", "t"]), ("//LI[1]/self::li", ["one", "other"]), ("//li[string-length(.) = 3]", ["one"]), ("descendant::b", ["!"]), (".//b", ["!"]),
    ("//nothing", []), ("//li[99]", []), ("//li[translate(., 'oen', 'OEN') = 'ONE']", ["one"]),
])
def test_paths(path, want):
    root = markup.parse(PAGE)
    assert [xpath.string([n]) for n in xpath.nodes(root, path)] == want


def test_paths_against_another_evaluator():
    rng = random.Random(9)

    def tree(level=0):
        inner = "".join(tree(level + 1) for _ in range(rng.randint(0, 3 if level < 4 else 0)))
        tag = rng.choice("uvw")
        return f'<{tag} n="{rng.randint(0, 2)}">{inner}</{tag}>'

    for _ in range(60):
        page = f"<x>{tree()}{tree()}</x>"
        root, other = markup.parse(page), ET.fromstring(page)
        mine, theirs = {id(e): i for i, e in enumerate(root.walk())}, {id(e): i for i, e in enumerate(other.iter())}
        for _ in range(20):
            tags = [rng.choice(("u", "v", "w", "*")) for _ in range(rng.randint(1, 3))]  # the other one counts positions by tag, also those of *
            steps = [t + rng.choice(("", "", '[@n="1"]', "[u]", *(("[1]", "[2]", "[last()]") if t != "*" else ()))) for t in tags]
            path = "".join(rng.choice(("/", "//")) + s for s in steps)
            got = [mine[id(e)] for e, _ in xpath.nodes(root, "/x" + path)]
            assert got == sorted({theirs[id(e)] for e in other.findall("." + path)}), (path, page)


def test_what_is_no_path():
    for path in ("", "//", "//li[", "//li[1", "li]", "//li[frob()]", "1 + 1", "//li/@", "#a", "count(//li)", "//li" * 2000, "(" * 500 + "a" + ")" * 500, "//li[contains(.)]"):
        assert markup.many(PAGE, "xpath", path) == [] and markup.one(PAGE, "xpath", path) == "", path


def test_fields_by_path():
    assert markup.one(PAGE, "xpath", "//a") == "/2" and markup.one(PAGE, "xpath", "//a/@title") == "t" and markup.one(PAGE, "xpath", "//a/text()") == "two"
    assert markup.one(PAGE, "xpath", "//a[@title]") == "t" and markup.one(PAGE, "xpath", "//li[2]") == "two and"


def test_expressions_of_the_tester():
    refused = [r"((a)+)+", r".*.*", r"[ab]{3,3}", r"a++", r"(?=(ab)*)"]
    assert [text.tester_regex(p) for p in refused] == [False] * 5
    assert all(text.tester_regex(p) for p in (r"\d+", r"(a|b)", r"[a-z]{2,5}", r"(?=ab)"))
    assert markup._timed("a1b22\nc", r"\d+", 5) == ["1", "22"] and markup._timed("ab\nc", "b.c", 5) == ["b\nc"] and markup._timed("Ab", "a", 5) == []
    assert markup._timed("x" * 40 + "!", r"(x|xx|x)*y|(x?){30}x{30}z", 5, 0.2) == [] and markup._timed("a", "(", 5) == []
