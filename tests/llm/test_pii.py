from __future__ import annotations

import datetime
import re

from pyspark.sql import functions as F

from foliant.llm import pii as x

from .cases import documents

KEY = "test key"


def luhn(number: str) -> bool:
    d = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0


def iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def shape(value: str) -> str:
    return re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value)))


VALID = {
    "card": ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "ip": ["192.168.0.1", "8.8.8.8", "255.255.255.255"],
    "date": ["1999-12-31", "29.02.2024", "01/02/1985"],
    "ssn": ["123-45-6789", "665-01-0001"],
    "phone": ["+49 170 1234567", "+1-555-123-4567"],
    "email": ["jane.doe@example.org", "a1@b.co"],
}
INVALID = ["4111 1111 1111 1112", "DE88 3704 0044 0532 0130 00", "256.1.1.1", "2023-02-30", "000-12-3456", "666-12-3456", "12", "not@mail"]


def test_valid_values_keep_their_format_and_link(spark):
    rows, expected, n = [], [], 0
    for kind, values in VALID.items():
        for v in values:
            rows += [(n, f"before {v} after."), (n + 1, f"{v}")]
            expected += [(kind, v)] * 2
            n += 2
    got = {r["doc_id"]: r for r in x.pseudonymise(documents(spark, rows), KEY).collect()}
    for i, (kind, v) in enumerate(expected):
        (f,) = got[i]["findings"]
        new = f["pseudonym"]
        assert (f["kind"], f["value"]) == (kind, v) and new != v
        assert got[i]["text"] == rows[i][1].replace(v, new)
        if kind == "email":
            assert len(new) == len(v) and new.split("@")[1] == v.split("@")[1]
        elif kind != "ip":
            assert shape(new) == shape(v)
        assert kind != "card" or luhn(new)
        assert kind != "iban" or iban_ok(new)
        assert kind != "ip" or all(0 <= int(p) <= 255 for p in new.split("."))
        if kind == "date":
            datetime.date.fromisoformat(new) if v[4] == "-" else datetime.datetime.strptime(new.replace("/", "."), "%d.%m.%Y")
    assert all(got[i]["findings"] == got[i + 1]["findings"] for i in range(0, n, 2))


def test_invalid_values_stay(spark):
    rows = list(enumerate(INVALID))
    got = {r["doc_id"]: r for r in x.pseudonymise(documents(spark, rows), KEY).collect()}
    assert all(got[i]["text"] == t and got[i]["findings"] == [] for i, t in rows)


def test_pairs_are_permuted(spark):
    pairs = spark.range(6).select(F.col("id").alias("x")).crossJoin(spark.range(7).select(F.col("id").alias("y")))
    moved = pairs.select("x", "y", x.permute_pair(F.col("x"), F.col("y"), 6, 7, KEY, "any").alias("p")).collect()
    assert {(r["p"]["x"], r["p"]["y"]) for r in moved} == {(r["x"], r["y"]) for r in moved}


def test_strings_are_permuted_by_key(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    got = df.select(x.permute_symbols(F.col("s"), x.DIGITS, KEY, "k").alias("p"), x.permute_symbols(F.col("s"), x.DIGITS, "other", "k").alias("q")).collect()
    assert len({r["p"] for r in got}) == len({r["q"] for r in got}) == 1000
    assert sum(r["p"] == r["q"] for r in got) < 30


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "8.8.8.8"), (4, "word " * 60_000 + "8.8.8.8"), (5, "8.8.8.8 8.8.8.8"), (5, "8.8.8.8 8.8.8.8"), (6, "no data")]
    got = x.pseudonymise(documents(spark, rows), KEY).collect()
    assert len(got) == len(rows)
    found = {(r["doc_id"], len(r["findings"])) for r in got}
    assert found == {(1, 0), (2, 0), (None, 1), (4, 1), (5, 2), (6, 0)}
    assert {r["text"] for r in got if r["doc_id"] in (1, 2)} == {""}
    assert len({f["pseudonym"] for r in got for f in r["findings"]}) == 1
    assert x.digest(x.pseudonymise(documents(spark, []), KEY)).count() == 0


def test_adjacent_values(spark):
    phone, card, ip = "+1 (826) 555-4081", "4111 1111 1111 1111", "190.137.223.204"
    rows = [
        (1, f"{phone} {ip}", [phone, ip]),
        (2, "4111111111111111 5500000000000004", ["4111111111111111", "5500000000000004"]),
        (3, f"2 {card}", [card]),
        (4, f"{phone} {card} {card}", [phone, card, card]),
        (5, f"{phone} 1999-12-31", [phone, "1999-12-31"]),
        (6, f"{phone} 123-45-6789 {phone}", [phone, "123-45-6789", phone]),
        (7, f"{card} 12", [card]),
    ]
    got = {r["doc_id"]: r for r in x.pseudonymise(documents(spark, [r[:2] for r in rows]), KEY).collect()}
    assert {i: [f["value"] for f in got[i]["findings"]] for i, _, _ in rows} == {i: v for i, _, v in rows}
    assert len({f["pseudonym"] for r in got.values() for f in r["findings"] if f["value"] == phone}) == 1
