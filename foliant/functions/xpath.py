"""XPath over a page's tree: steps, positions among the nodes of a step, predicates, axes, unions and the usual functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

TOKEN = re.compile(r"\s*(?:(//|/|\.\.|\.|::|@|\[|\]|\(|\)|,|\||!=|<=|>=|=|<|>|\*|\+|-(?![\w]))|(\d+(?:\.\d+)?)|\"([^\"]*)\"|'([^']*)'|([A-Za-z_][\w.-]*))")
LONGEST = 2000

#: (element, None) for an element, (element, name) for its attribute, (element, place) for a text among its parts.
Node = tuple
Context = tuple  # node, position, size


def _elements_below(e) -> Iterator:
    return ((x, None) for x in e.walk())


def _siblings(e, after: bool) -> list:
    own = [p for p in (e.up.parts if e.up is not None else ()) if not isinstance(p, str)]
    at = next((i for i, p in enumerate(own) if p is e), 0)
    return own[at + 1 :] if after else own[:at][::-1]


def _ups(e) -> list:
    out = []
    while e.up is not None:
        e = e.up
        out.append(e)
    return out


AXES: dict[str, Callable] = {
    "child": lambda e: ((p, None) if not isinstance(p, str) else (e, i) for i, p in enumerate(e.parts)),
    "descendant": lambda e: ((q, None) if not isinstance(q, str) else (x, i) for x in (e, *e.walk()) for i, q in enumerate(x.parts)),
    "descendant-or-self": lambda e: ((e, None), *_elements_below(e)),
    "self": lambda e: ((e, None),),
    "parent": lambda e: ((e.up, None),) if e.up is not None else (),
    "ancestor": lambda e: ((u, None) for u in _ups(e)),
    "ancestor-or-self": lambda e: ((u, None) for u in (e, *_ups(e))),
    "following-sibling": lambda e: ((s, None) for s in _siblings(e, True)),
    "preceding-sibling": lambda e: ((s, None) for s in _siblings(e, False)),
    "attribute": lambda e: ((e, name) for name in e.attrs),
}


def string(value) -> str:
    if isinstance(value, list):
        if not value:
            return ""
        e, part = value[0]
        return e.text() if part is None else e.attrs[part] if isinstance(part, str) else e.parts[part]
    if isinstance(value, bool):
        return "true" if value else "false"
    return f"{value:g}" if isinstance(value, float) else value


def number(value) -> float:
    if isinstance(value, bool | float):
        return float(value)
    try:
        return float(string(value).strip())
    except ValueError:
        return float("nan")


def truth(value) -> bool:
    return bool(value) and value == value if isinstance(value, float) else bool(value)


COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
FUNCTIONS: dict[str, Callable] = {
    "position": lambda c: float(c[1]), "last": lambda c: float(c[2]), "true": lambda c: True, "false": lambda c: False, "not": lambda c, a: not truth(a), "count": lambda c, a: float(len(a)),
    "contains": lambda c, a, b: string(b) in string(a), "starts-with": lambda c, a, b: string(a).startswith(string(b)), "concat": lambda c, *a: "".join(map(string, a)),
    "string": lambda c, a=None: string([c[0]] if a is None else a), "normalize-space": lambda c, a=None: " ".join(string([c[0]] if a is None else a).split()),
    "string-length": lambda c, a=None: float(len(string([c[0]] if a is None else a))), "number": lambda c, a=None: number([c[0]] if a is None else a), "name": lambda c: c[0][0].tag,
    "translate": lambda c, a, b, d: string(a).translate({ord(x): string(d)[i] if i < len(string(d)) else None for i, x in reversed(list(enumerate(string(b))))}),
}


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        text = text.rstrip()
        if len(text) > LONGEST:
            raise ValueError("a path that long isn't taken")
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not a path: {text!r}")
            kind = next(i for i in range(1, 6) if m[i] is not None)
            self.tokens.append(("op", "number", "text", "text", "name")[kind - 1 : kind] + (m[kind],))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ValueError(f"{value!r} is missing")

    def whole(self):
        found = self.either()
        if self.peek()[0] != "end":
            raise ValueError(f"{self.peek()[1]!r} can't stand there")
        return found

    def _joined(self, part: Callable, word: str, fold: Callable):
        parts = [part()]
        while self.peek() == ("name", word):
            self.at += 1
            parts.append(part())
        return parts[0] if len(parts) == 1 else (lambda c: fold(truth(p(c)) for p in parts))

    def either(self):
        return self._joined(self.both, "or", any)

    def both(self):
        return self._joined(self.compared, "and", all)

    def compared(self):
        left = self.union()
        while op := self.take(*COMPARE):
            left = self._compare(left, COMPARE[op], op, self.union())
        return left

    @staticmethod
    def _compare(left, test, op, right):
        def run(c):
            a, b = left(c), right(c)
            if isinstance(a, bool) or isinstance(b, bool):
                return test(truth(a), truth(b))
            numeric = op not in ("=", "!=") or isinstance(a, float) or isinstance(b, float)
            each = lambda v: [[n] for n in v] if isinstance(v, list) else [v]
            return any(test(number(x), number(y)) if numeric else test(string(x), string(y)) for x in each(a) for y in each(b))

        return run

    def union(self):
        paths = [self.path()]
        while self.take("|"):
            paths.append(self.path())
        return paths[0] if len(paths) == 1 else (lambda c: [n for p in paths for n in p(c)])

    def path(self):
        kind, value = self.peek()
        if kind == "number":
            self.at += 1
            return lambda c, n=float(value): n
        if kind == "text":
            self.at += 1
            return lambda c, t=value: t
        if kind == "name" and self.peek(1) == ("op", "(") and value not in ("text", "node"):
            return self.call()
        if self.take("("):
            inner = self.either()
            self.need(")")
            steps = self.predicates(inner)
            return self.steps(steps, []) if self.peek() in (("op", "/"), ("op", "//")) else steps
        start = self.take("/", "//")
        if start and self.peek()[0] == "end":
            raise ValueError("a path needs a step")
        first = (lambda c: [(_top(c[0][0]), None)]) if start else (lambda c: [c[0]])
        return self.steps(first, ["descendant-or-self"] if start == "//" else [], bare=True)

    def predicates(self, inner):
        while self.take("["):
            test = self.either()
            self.need("]")
            inner = lambda c, inner=inner, test=test: _kept(inner(c), test)
        return inner

    def call(self):
        name = self.peek()[1]
        if name not in FUNCTIONS:
            raise ValueError(f"no function {name}")
        self.at += 2
        args = []
        while not self.take(")"):
            if args:
                self.need(",")
            args.append(self.either())
        return lambda c: FUNCTIONS[name](c, *(a(c) for a in args))

    def steps(self, first, before: list[str], bare: bool = False):
        steps = [(AXES[a], lambda n: True, []) for a in before]
        if bare:
            steps.append(self.step())
        while op := self.take("/", "//"):
            if op == "//":
                steps.append((AXES["descendant-or-self"], lambda n: True, []))
            steps.append(self.step())

        def run(c):
            nodes = first(c)
            for axis, test, predicates in steps:
                out: dict = {}
                for e, part in nodes:
                    found = [n for n in axis(e) if test(n)] if part is None else []
                    for p in predicates:
                        found = _kept(found, p)
                    out.update(((id(n[0]), n[1]), n) for n in found)
                nodes = list(out.values())
            return nodes

        return run

    def step(self):
        if self.take(".."):
            return AXES["parent"], lambda n: True, []
        if self.take("."):
            return AXES["self"], lambda n: True, []
        axis = "attribute" if self.take("@") else "child"
        if self.peek()[0] == "name" and self.peek(1) == ("op", "::"):
            axis = self.peek()[1]
            self.at += 2
        kind, value = self.peek()
        if axis not in AXES or not (kind == "name" or value == "*"):
            raise ValueError(f"not a step: {value!r}")
        self.at += 1
        if value in ("text", "node") and self.take("("):
            self.need(")")
            test = (lambda n: isinstance(n[1], int)) if value == "text" else (lambda n: True)
        elif axis == "attribute":
            test = (lambda n: True) if value == "*" else (lambda n, v=value.lower(): n[1] == v)
        else:
            test = (lambda n: n[1] is None and n[0].up is not None) if value == "*" else (lambda n, v=value.lower(): n[1] is None and n[0].tag == v)
        predicates = []
        while self.take("["):
            predicates.append(self.either())
            self.need("]")
        return AXES[axis], test, predicates


def _kept(nodes: list, test) -> list:
    out = []
    for i, n in enumerate(nodes, 1):
        value = test((n, i, len(nodes)))
        if value == i if isinstance(value, float) else truth(value):
            out.append(n)
    return out


def _top(e):
    while e.up is not None:
        e = e.up
    return e


@lru_cache(256)
def compiled(path: str):
    return _Parser(path).whole()


def nodes(root, path: str) -> list[Node]:
    """The nodes of a path over a page's root, each once, in page order. A path that isn't one is a ValueError."""
    found = compiled(path)(((root, None), 1, 1))
    if not isinstance(found, list):
        raise ValueError("the path gives no nodes")
    place = {id(e): i for i, e in enumerate(root.walk())}
    once = {(id(e), part): (e, part) for e, part in found}
    return sorted(once.values(), key=lambda n: (place.get(id(n[0]), -1), -1 if n[1] is None else list(n[0].attrs).index(n[1]) if isinstance(n[1], str) else n[1]))
