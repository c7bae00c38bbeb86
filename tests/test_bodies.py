"""JSON bodies: their shape and their pages, against a walk over the parsed value."""

from __future__ import annotations

import json
import random
from html import escape

import pytest
from pyspark.sql import functions as F

from foliant.sources import pages


def depth(value, at=0):
    below = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return max([at, *(depth(v, at + 1) for v in below)])


def keys(value):
    below = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
    return max([len(value) if isinstance(value, dict) else 0, *map(keys, below)])


def made(rng, level=0):
    kind = rng.random()
    if level > 4 or kind < 0.35:
        return rng.choice([1, -2.5, True, None, "", 'a "q" \\ [x]: {y}', "é🙂\n", "{}", "]"])
    if kind < 0.65:
        return [made(rng, level + 1) for _ in range(rng.randint(0, 4))]
    return {f"k{i}{rng.choice(['', ':', '[', ' '])}": made(rng, level + 1) for i in range(rng.randint(0, 5))}


def test_shapes(spark):
    rng = random.Random(8)
    values = [made(rng) for _ in range(400)] + [[[[]]], {"a": {}}, {str(i): i for i in range(250)}]
    bodies = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1))) for v in values]
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, b string").repartition(3)
    got = {r["i"]: (r["s"]["depth"], r["s"]["keys"]) for r in df.select("i", pages.json_shape(F.col("b")).alias("s")).collect()}
    assert got == {i: (depth(v), keys(v)) for i, v in enumerate(values)}


def test_limits(spark):
    nested = lambda n: "[" * n + "1" + "]" * n
    wide = lambda n: json.dumps({str(i): 1 for i in range(n)})
    bodies = [nested(20), nested(21), "[" * 21 + "]" * 21, wide(200), wide(201), "", None, "{", '{"a": 1}}', "1 2", '"a""b"', "[] x", "[1] [2]", "[1]]", '"' + "x" * (1 << 20) + '"', '"' + "x" * ((1 << 20) - 2) + '"']
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, b string").coalesce(1)
    rows = df.select("i", pages.json_depth_ok(F.col("b")).alias("d"), pages.json_keys_ok(F.col("b")).alias("k")).orderBy("i").collect()
    assert [r["d"] for r in rows] == [True, False, True, True, True, *[False] * 10, True]
    assert [r["k"] for r in rows] == [True, True, True, True, *[False] * 11, True]


@pytest.mark.parametrize("cut", [False, True])
def test_record_pages(spark, cut):
    shown = lambda t: escape(t, quote=False).replace('"', "&quot;")
    text = lambda v: v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    spans = lambda r: " ".join(f'<span data-field="{k}">{shown(text(v))}</span>' for k, v in r.items() if v is not None)

    def page(record):
        blocks = []
        for key, value in record.items() if isinstance(record, dict) else ():
            for item in value if isinstance(value, list) else [value]:
                if isinstance(item, str):
                    blocks.append(f'<div data-field="{key}">{shown(item)}</div>')
                elif isinstance(item, dict):
                    mark = ' data-item="true"' if isinstance(value, list) else ""
                    blocks.append(f'<div data-field="{key}"{mark}>{spans(item)}</div>')
        return "<html><body>" + "\n".join(blocks) + "</body></html>"

    values = [
        {"z": "last <first>", "a": ["x", None, 3, {"b": 1, "a": 'q"', "n": None}, ["deep"], "y"], "m": {"k": [1, 2], "j": {"i": 1}, "t": True}, "n": None, "v": 5, "f": False},
        {}, [], ["x"], "text", 7, None, {"s": '{"not": "a record"}', "l": [], "o": {}, "e": ""},
    ]
    bodies = [json.dumps(v, separators=(",", ":")) for v in values]
    bodies = [b[:-1] + "," for b in bodies] if cut else bodies
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, b string")
    got = [r[0] for r in df.select("i", pages.nested_record_html(F.col("b")).alias("p")).orderBy("i").select("p").collect()]
    assert got == ([None] * len(values) if cut else [page(v) for v in values])


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("{}",)], "b string").select(pages.nested_record_html(F.col("b")), pages.json_shape(F.col("b")))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
