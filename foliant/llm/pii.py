"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Candidates are found by one pattern and then validated: card numbers by their check digit, IBANs by theirs, IPv4
addresses by their octets, social security numbers by their ranges, dates by the calendar, phone numbers by their digits, and
mail addresses. A valid value is replaced by a keyed permutation of itself within its format: a Feistel network of
ROUNDS rounds whose round function is SHA-256 of the key, the kind, the round and the other half. The halves are either
numbers modulo the two factors of the format's size, or runs of symbols added modulo the alphabet. So the pseudonym is as valid as
the value (check digits are computed anew), different values stay different, and equal values are linked across documents.

Each document is one row of a narrow stage: what lies between candidates is kept as it is.

Defined results: null and empty texts stay empty with no findings; invalid candidates stay and don't count; dates
outside of the 72,900 days from 1900-01-01 stay, and so do dates with the month's name; 03/04/2020 counts as a day of April; 12/31/1999, one of
December, becomes another month-first date of the first 44,100 (up to April 2099; later ones stay); very long texts are one row each, matched without backtracking over their length, and a
very long value takes time in proportion to its length; an empty table gives no rows; repeated rows are treated each; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import body

ROUNDS = 8
DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABET = DIGITS + LETTERS + LETTERS.upper()

#: An unbroken run or the usual groups with one separator. A chain of groups of four is searched for its first valid cards.
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?: \d{4}(?!\d|-\d)){3,}+|\d{4}(?:-\d{4}(?!\d)){3,}+|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"

# Lengths of account numbers by country, of the public IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
# The country codes of one and two digits; all others have three.
COUNTRY_CODE = r"^\+(?:\d{1,3}(?=[ (-])|[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

# Patterns of the kinds, in order of preference. No group of a phone number starts another value.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "iban": rf"(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])",
    "ip": IP,
    "date": DATE,
    "ssn": SSN,
    "phone": rf"(?<![\p{{L}}\p{{N}}])\+\d{{1,3}}[ -]?\(?\d{{2,4}}\)?(?:[ -]?(?!(?<!\d-){CARD}|{IP}|{DATE}|{SSN})\d{{2,4}}){{2,4}}(?!\d|\.\d)|(?<![\p{{L}}\p{{N}}+-])(?:\([2-9]\d{{2}}\) ?|[2-9]\d{{2}}[-.])[2-9]\d{{2}}[-.]\d{{4}}(?![\d-]|\.\d)",
    "card": CARD,
}
KINDS = tuple(PATTERNS)
FIRST_DAY, DAYS_ROOT = "1900-01-01", 270
#: Month-first dates are those of the days from the 13th on; so many squared of them are permuted among each other.
LATE_ROOT = 210


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once: lambdas are the only names inside of a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def _round(key: Column | str, kind: str, r: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), half).cast("binary"), 256)


def permute_pair(x: Column, y: Column, mx: int, my: int, key: Column | str, kind: str) -> Column:
    """struct(x, y): a keyed permutation of the pairs with 0 <= x < mx and 0 <= y < my."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(mx).cast("long").alias("mx"), F.lit(my).cast("long").alias("my"))

    def step(s: Column, r: Column) -> Column:
        add = F.conv(F.substring(_round(key, kind, r, s["y"].cast("string")), 1, 14), 16, 10).cast("long")
        return F.struct(s["y"].alias("x"), F.pmod(s["x"] + add, s["mx"]).alias("y"), s["my"].alias("mx"), s["mx"].alias("my"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permute_symbols(s: Column, alphabet: str, key: Column | str, kind: str) -> Column:
    """A keyed permutation of the strings of one length over an alphabet; a single symbol is moved by a keyed step, so that
    none stays as it is (of longer strings, one on average does)."""

    def step(p: Column, r: Column) -> Column:
        def add(word: Column) -> Column:
            return F.transform(
                p["x"], lambda c, i: F.pmod(c + F.conv(F.substring(word, (i % 30) * 2 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(len(alphabet))).cast("int")
            )

        word = _round(key, kind, r, F.array_join(F.transform(p["y"], lambda c: c.cast("string")), "."))
        return F.struct(p["y"].alias("x"), _let(word, add).alias("y"))

    def walk(codes: Column) -> Column:
        alone = F.conv(F.substring(_round(key, kind, F.lit(0), F.lit("")), 1, 8), 16, 10).cast("long") % (len(alphabet) - 1) + 1
        half = F.floor(F.size(codes) / 2).cast("int")
        start = F.struct(F.slice(codes, F.lit(1), half).alias("x"), F.slice(codes, half + 1, F.size(codes) + 1).alias("y"))
        mixed = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda p: F.concat(p["x"], p["y"]))
        return F.when(F.size(codes) == 1, F.transform(codes, lambda c: F.pmod(c + alone, F.lit(len(alphabet))).cast("int"))).otherwise(mixed)

    codes = F.transform(_chars(s), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("int"))
    return F.array_join(F.transform(_let(codes, walk), lambda c: F.substring(F.lit(alphabet), c + 1, F.lit(1))), "")


def _refill(value: Column, fresh: Column, symbols: str) -> Column:
    """value with its characters of the class `symbols`, in order, replaced by those of fresh."""

    between = F.split(value, f"[{symbols}]", -1)
    woven = F.zip_with(between, _chars(fresh), lambda kept, new: F.concat(kept, F.coalesce(new, F.lit(""))))
    return F.array_join(woven, "")


def _luhn(digits: Column) -> Column:
    """The check sum over all digits, from the right, every second one doubled."""
    doubled = F.transform(
        F.reverse(_chars(digits)),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, c: a + c)


def _mod97(text: Column) -> Column:
    """The IBAN remainder of letters and digits, letters counting 10 to 35."""
    numbers = F.transform(_chars(text), lambda c: F.instr(F.lit(DIGITS + LETTERS.upper()), c) - 1)
    return F.aggregate(numbers, F.lit(0), lambda a, n: F.pmod(a * F.when(n > 9, F.lit(100)).otherwise(F.lit(10)) + n, F.lit(97)))


def _valid_card(digits: Column) -> Column:
    return F.pmod(_luhn(digits), F.lit(10)) == 0


def _fresh_card(digits: Column, key: Column | str) -> Column:
    payload = permute_symbols(F.substring(digits, F.lit(1), F.length(digits) - 1), DIGITS, key, "card")
    check = lambda p: F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(p, F.lit("0"))), F.lit(10)), F.lit(10))
    return _let(payload, lambda p: F.concat(p, check(p).cast("string")))


def _card(x: Column, key: Column | str) -> Column:
    """One card, or a chain of groups of four in which each first valid run of four groups is a card."""

    def one(digits: Column) -> Column:
        return F.when(_valid_card(digits), _refill(x, _fresh_card(digits, key), "0-9"))

    def chain(groups: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))

        def step(s: Column, i: Column) -> Column:
            def told(digits: Column) -> Column:
                right = (s["skip"] == 0) & (F.length(digits) == 16) & _valid_card(digits)
                card = lambda d: F.array(*[F.substring(d, at, 4) for at in (1, 5, 9, 13)])
                added = F.when(s["skip"] > 0, F.array().cast("array<string>")).when(right, _let(_fresh_card(digits, key), card)).otherwise(F.slice(groups, i, F.lit(1)))
                skip = F.when(s["skip"] > 0, s["skip"] - 1).when(right, F.lit(3)).otherwise(F.lit(0))
                return F.struct(F.concat(s["out"], added).alias("out"), skip.alias("skip"))

            return _let(F.array_join(F.slice(groups, i, F.lit(4)), ""), told)

        done = F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step)
        any_card = F.exists(F.sequence(F.lit(1), F.size(groups) - 3), lambda i: _valid_card(F.array_join(F.slice(groups, i, F.lit(4)), "")))
        return F.when(any_card, _let(done, lambda d: F.array_join(d["out"], " ")))

    def chained(sep: str) -> Column:
        return F.translate(_let(F.split(x, sep), chain), " ", sep)

    kind = [x.rlike(rf"^\d{{4}}(?:{sep}\d{{4}}){{3,}}$") for sep in (" ", "-")]
    return F.when(kind[0], chained(" ")).when(kind[1], chained("-")).otherwise(_let(F.regexp_replace(x, "[^0-9]", ""), one))


def _iban(x: Column, key: Column | str) -> Column:
    def fresh(plain: Column) -> Column:
        country, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        body_ = _refill(rest, permute_symbols(F.regexp_replace(rest, "[^0-9]", ""), DIGITS, key, "iban"), "0-9")
        check = lambda b: F.lpad((F.lit(98) - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        valid = _mod97(F.concat(rest, F.substring(plain, 1, 4))) == 1
        return F.when(valid & F.length(plain).between(15, 34), _refill(x, _let(body_, lambda b: F.concat(country, check(b), b)), "A-Z0-9"))

    return _let(F.replace(x, F.lit(" "), F.lit("")), fresh)


def _ip(x: Column, key: Column | str) -> Column:
    def fresh(o: Column) -> Column:
        new = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        dotted = _let(new, lambda p: F.concat_ws(".", *[n.cast("string") for h in ("x", "y") for n in (F.floor(p[h] / 256), p[h] % 256)]))
        return F.when(F.forall(o, lambda n: n <= 255), dotted)

    return _let(F.transform(F.split(x, r"\."), lambda p: p.cast("int")), fresh)


def _late_rank(day: Column) -> Column:
    """The number of days from the 13th of a month on between FIRST_DAY and a day that is one itself."""
    months = (F.year(day) - 1900) * 12 + F.month(day)
    return F.datediff(day, F.lit(FIRST_DAY).cast("date")) - months * 12


def _late_day(rank: Column) -> Column:
    """The day of a rank: the last month from whose 13th on the ranks reach it."""
    first = F.lit(FIRST_DAY).cast("date")
    begun = lambda m: F.date_add(F.add_months(first, m), 12)
    guess = F.floor(rank / (365.2425 / 12 - 12)).cast("int")
    near = F.filter(F.sequence(guess - 1, guess + 1), lambda m: (m >= 0) & (_late_rank(begun(m)) <= rank))
    return _let(begun(F.array_max(near)), lambda day: F.date_add(day, (rank - _late_rank(day)).cast("int")))


def _date(x: Column, key: Column | str) -> Column:
    plain = F.translate(x, "./", "--")
    iso = x.rlike("^[0-9]{4}")
    day_first = F.try_to_date(plain, "dd-MM-yyyy")

    def fresh(day: Column, form: str) -> Column:
        def moved(n: Column) -> Column:
            new = permute_pair(F.floor(n / DAYS_ROOT), n % DAYS_ROOT, DAYS_ROOT, DAYS_ROOT, key, "date")
            date = _let(new, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["x"] * DAYS_ROOT + p["y"]).cast("int")))
            return F.when((n >= 0) & (n < DAYS_ROOT * DAYS_ROOT), _refill(x, F.date_format(date, form), "0-9"))

        return _let(F.datediff(day, F.lit(FIRST_DAY).cast("date")), moved)

    def month_first(day: Column) -> Column:
        """Never a day-first date, whose second number is a month: the days from the 13th on are permuted by their ranks."""

        def moved(n: Column) -> Column:
            new = permute_pair(F.floor(n / LATE_ROOT), n % LATE_ROOT, LATE_ROOT, LATE_ROOT, key, "late date")
            date = _let(_let(new, lambda p: (p["x"] * LATE_ROOT + p["y"]).cast("int")), _late_day)
            return F.when((n >= 0) & (n < LATE_ROOT * LATE_ROOT), _refill(x, F.date_format(date, "MMddyyyy"), "0-9"))

        return _let(F.when(day >= F.lit(FIRST_DAY).cast("date"), _late_rank(day)), moved)

    early = F.when(day_first.isNotNull(), fresh(day_first, "ddMMyyyy")).otherwise(month_first(F.try_to_date(plain, "MM-dd-yyyy")))
    return F.when(iso, fresh(F.try_to_date(plain, "yyyy-MM-dd"), "yyyyMMdd")).otherwise(early)


def _ssn(x: Column, key: Column | str) -> Column:
    area, group, serial = (p.cast("int") for p in (F.substring(x, 1, 3), F.substring(x, 5, 2), F.substring(x, 8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, F.lit(1)).otherwise(F.lit(0))

    def written(new: Column) -> Column:
        at = F.floor(new["x"] / 99)
        parts = ((at + 1 + F.when(at >= 665, F.lit(1)).otherwise(F.lit(0)), 3), (new["x"] % 99 + 1, 2), (new["y"] + 1, 4))
        return F.concat_ws("-", *[F.lpad(n.cast("string"), w, "0") for n, w in parts])

    return F.when(valid, _let(permute_pair(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), written))


def _phone(x: Column, key: Column | str) -> Column:
    def fresh(code: Column) -> Column:
        rest = F.substring(x, F.length(code) + 1, F.length(x))
        digits = F.regexp_replace(rest, "[^0-9]", "")
        return F.when(F.length(digits).between(7, 14), F.concat(code, _refill(rest, permute_symbols(digits, DIGITS, key, "phone"), "0-9")))

    return _let(F.regexp_extract(x, COUNTRY_CODE, 0), fresh)


def _email(x: Column, key: Column | str) -> Column:
    def fresh(local: Column) -> Column:
        new = permute_symbols(F.regexp_replace(local, "[^A-Za-z0-9]", ""), ALPHABET, key, "email")
        return F.concat(_refill(local, new, "A-Za-z0-9"), F.substring(x, F.length(local) + 1, F.length(x)))

    return _let(F.substring_index(x, "@", 1), fresh)


_REPLACE = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _finding(x: Column, key: Column | str) -> Column:
    """struct(kind, value, pseudonym) of a candidate; the pseudonym is null if it isn't valid."""

    def fresh(kind: Column) -> Column:
        new = reduce(lambda rest, k: F.when(kind == k, _REPLACE[k](x, key)).otherwise(rest), reversed(KINDS), F.lit(None).cast("string"))
        return F.struct(kind.alias("kind"), x.alias("value"), new.alias("pseudonym"))

    kind = reduce(lambda rest, k: F.when(x.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(rest), reversed(KINDS), F.lit(None).cast("string"))
    return _let(kind, fresh)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(doc_id, text, findings array<struct<kind, value, pseudonym>>) of every row."""
    pattern = "|".join(PATTERNS[k] for k in KINDS)
    secret = docs.sparkSession.createDataFrame([(key,)], "secret string")  # a row, so that no plan, log or page shows it
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body(text).alias("text")).crossJoin(F.broadcast(secret))
    found = rows.withColumn("seen", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    found = found.withColumn("made", F.transform("seen", lambda x: _finding(x, F.col("secret"))))
    between = F.split("text", pattern, -1)
    fresh = F.transform("made", lambda f: F.coalesce(f["pseudonym"], f["value"]))
    woven = F.array_join(F.zip_with(between, fresh, lambda g, v: F.concat(F.coalesce(g, F.lit("")), F.coalesce(v, F.lit("")))), "")
    return found.select(
        "doc_id",
        F.when(F.size("made") == 0, F.col("text")).otherwise(woven).alias("text"),
        F.flatten(F.transform(F.filter("made", lambda f: f["pseudonym"].isNotNull()), _each_card)).alias("findings"),
    )


def _each_card(f: Column) -> Column:
    """The findings of a finding: a chain of groups may hold several cards."""
    def listed(groups: Column) -> Column:
        none = F.array(F.struct(f["kind"].alias("kind"), f["value"].alias("value"), f["pseudonym"].alias("pseudonym")))
        start = F.struct(F.slice(none, 1, 0).alias("out"), F.lit(0).alias("skip"))

        def step(s: Column, i: Column) -> Column:
            right = (s["skip"] == 0) & (i + 3 <= F.size(groups)) & _valid_card(F.array_join(F.slice(groups, i, F.lit(4)), ""))
            cut = [F.substring(f[c], (i - 1) * 5 + 1, F.lit(19)).alias(c) for c in ("value", "pseudonym")]
            out = F.when(right, F.concat(s["out"], F.array(F.struct(f["kind"].alias("kind"), *cut)))).otherwise(s["out"])
            return F.struct(out.alias("out"), F.when(right, F.lit(3)).otherwise(F.greatest(s["skip"] - 1, F.lit(0))).alias("skip"))

        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda s: s["out"])

    chained = (f["kind"] == "card") & (F.length(f["value"]) > 19) & f["value"].rlike("^\\d{4}[ -]")
    return F.when(chained, _let(F.split(F.translate(f["value"], "-", " "), " "), listed)).otherwise(F.array(f))


def _is(kind: str):
    return lambda f: f["kind"] == kind


def digest(done: DataFrame) -> DataFrame:
    """The new text with counts of each kind."""
    counts = [F.size(F.filter("findings", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", *counts, F.size("findings").cast("long").alias("n_found"), (F.size("findings") > 0).alias("private"), "text")
