"""Values planted at known places: the valid ones change within their format, all else stays, neighbours included."""

from __future__ import annotations

import random
import re
import time
from datetime import date, timedelta

from pyspark.sql import functions as F

from foliant.llm import pii as x

from .cases import by_id, documents

KEY = "a key"


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> int:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def form(s: str) -> str:
    return re.sub(r"[0-9]", "9", s)


PLANTED = {
    "phone": ["+491701234567", "+33612345678", "+1 (826) 555-4081", "+44 20 7946 0958", "+12025550123", "(212) 555-0187", "212-555-0187"],
    "card": ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "3782 822463 10005"],
    "date": ["12/31/1999", "31.12.1999", "2001-02-28", "2001/02/28"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "ip": ["192.168.17.4"],
    "ssn": ["219-09-9999"],
    "email": ["jane.doe+x@mail.example.org", "q@b.co"],
}
INVALID = ["4111 1111 1111 1112", "99/99/1999", "2001-13-01", "300.1.2.3", "DE89 3704 0044 0532 0130 01", "000-12-3456", "7", "2024", "12/27", "AND"]
OPEN = [" ", ", ", "; ", " and ", " near "]


def made():
    rng, rows = random.Random(3), []
    values = [(k, v) for k, vs in PLANTED.items() for v in vs]
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 7)):
            parts += [(None, rng.choice(INVALID))] if rng.random() < 0.3 else [rng.choice(values)]
            parts.append((None, rng.choice(OPEN[1:]) + "x "))
        rows.append((i, parts))
    return rows


def test_planted_values(spark):
    rows = made()
    done = by_id(x.pseudonymise(documents(spark, [(i, "".join(v for _, v in parts)) for i, parts in rows]), KEY))
    links: dict[str, str] = {}
    for i, parts in rows:
        text, at = done[i]["text"], 0
        for kind, value in parts:
            got = re.compile(r"[0-9.]+[0-9]").match(text, at)[0] if kind == "ip" else text[at : at + len(value)]
            at += len(got)
            if kind is None:
                assert got == value, (i, parts, text)
                continue
            assert links.setdefault(value, got) == got
            if kind == "email":
                assert got.partition("@")[2] == value.partition("@")[2] and got != value
            elif kind == "ip":
                assert got != value and all(int(n) < 256 for n in got.split("."))
            else:
                assert form(got) == form(value) and got != value, (kind, value, got)
            digits = re.sub(r"\D", "", got)
            if kind == "card":
                assert luhn(digits)
            elif kind == "iban":
                assert mod97(got) == 1 and got[:2] == value[:2]
            elif kind == "date" and got[4] in "-/":
                date.fromisoformat(got.replace("/", "-"))
            elif kind == "phone" and value[0] == "+":
                assert got[:3] == value[:3] or value[1] in "17" and got[:2] == value[:2]
        assert at == len(text)
        assert [f["kind"] for f in done[i]["findings"]] == [k for k, _ in parts if k]
    assert len(set(links.values())) == len(links)
    assert links["4111 1111 1111 1111"].replace(" ", "") == links["4111111111111111"], "one card, however it is written"


def test_neighbours(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 12/27", f"{card} 123", f"7 {card}", f"1234 {card}", f"{card} 5678", f"{card} {card}", "+1 (826) 555-4081 190.137.223.204", "7536784127813050 4845168114407329"]
    done = by_id(x.pseudonymise(documents(spark, list(enumerate(texts))), KEY))
    new = done[0]["text"][:19]
    assert luhn(new.replace(" ", "")) and new != card
    assert [done[i]["text"] for i in range(6)] == [f"{new} 12/27", f"{new} 123", f"7 {new}", f"1234 {new}", f"{new} 5678", f"{new} {new}"]
    assert [f["kind"] for f in done[6]["findings"]] == ["phone", "ip"]
    assert len(done[7]["findings"]) == sum(map(luhn, texts[7].split()))


def test_long_broken_texts(spark):
    texts = ["a@" + "b." * 20_000 + "c", "1111 " * 20_000, "+1 22" * 5_000, "DE89 " * 10_000, "1.2." * 20_000]
    done = by_id(x.pseudonymise(documents(spark, list(enumerate(texts))), KEY))
    assert [len(done[i]["text"]) for i in range(5)] == [len(t) for t in texts]
    assert done[0]["findings"][0]["kind"] == "email"


def test_dates_stay_different(spark):
    """Every date of ten years, written both ways where that can be told: as many pseudonyms, none of the other form."""
    days = [date(1990, 1, 1) + timedelta(n) for n in range(3652)]
    late = [d.strftime("%m/%d/%Y") for d in days if d.day > 12]
    early = [d.strftime("%d/%m/%Y") for d in days]
    edge = ["01/13/1900", "12/31/1899", "04/30/2099", "05/31/2099", "12/31/2099"]
    done = by_id(x.pseudonymise(documents(spark, list(enumerate(late + early + edge))), KEY))
    new = [done[i]["text"] for i in range(len(late + early + edge))]
    assert len(set(new)) == len(new)
    for t in new[: len(late)]:
        assert date(int(t[6:]), int(t[:2]), int(t[3:5])).day > 12 and int(t[6:]) < 2100
    for t in new[len(late) : len(late + early)]:
        date(int(t[6:]), int(t[3:5]), int(t[:2]))
    assert new[-4] == "12/31/1899" and new[-1] == "12/31/2099"


def test_ranks_of_late_days(spark):
    ranks = spark.range(x.LATE_ROOT**2).select("id", x._late_day(F.col("id")).alias("day"))
    got = ranks.select("day", (x._late_rank(F.col("day")) == F.col("id")).alias("same"), (F.dayofmonth("day") > 12).alias("late")).toPandas()
    assert got["same"].all() and got["late"].all() and got["day"].nunique() == x.LATE_ROOT**2 and str(got["day"].min()) == "1900-01-13"


def test_very_long_value(spark):
    """One address of 16,000 and of 256,000 characters: time by length, not by its square."""

    def seconds(n: int) -> float:
        docs, began = documents(spark, [(1, "ab.c" * (n // 4) + "@example.org")], clash=False), time.perf_counter()
        (row,) = x.pseudonymise(docs, KEY).collect()
        assert len(row["text"]) == n + 12 and row["text"].endswith("@example.org") and row["text"][2::4][:50] == "." * 50
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(256_000) < 16 * max(seconds(16_000), 1.0)


def test_plans_hide_the_key(spark):
    done = x.pseudonymise(documents(spark, [(1, "8.8.8.8")]), "a key nobody may read")
    assert "nobody may read" not in done._jdf.queryExecution().toString() and done.collect()


def test_one_letter_names_change(spark):
    rows = [(i, f"{c}@example.org") for i, c in enumerate(x.ALPHABET)]
    for key in ("a", "b", "c"):
        done = by_id(x.pseudonymise(documents(spark, rows, clash=False), key))
        assert len({r["text"] for r in done.values()}) == len(rows) and all(done[i]["text"] != t for i, t in rows)
