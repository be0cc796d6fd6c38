"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Candidates are found by one pattern and validated by kind: payment card
numbers (13 to 19 digits, Luhn), US social security numbers (area, group and
serial in range), IPv4 addresses (octets to 255), phone numbers (7 to 15
digits in an international or North American form), dates (real days from
1900 to 2099, ISO, ``d.m.yyyy``, ``m/d/yyyy`` or ``d/m/yyyy``) and e-mail
addresses.  What fails validation stays as it is.

A validated value is an index into the set of all values of its format.  A
balanced Feistel network over pairs of residues (``ROUNDS`` rounds, keyed
SHA-256 as round function) permutes a square that holds the set; indices that
land outside walk on until they are inside.  So each format is permuted onto
itself: equal values get equal pseudonyms in every document, different values
different ones, lengths and separators stay.  The format of a date is its
order, its separator and the lengths of its day and month as written
(``5.12.2001`` and ``05.12.2001`` are of two formats); a ``d/m/yyyy`` date,
known by a day over 12, gets one over 12 again, so no two written dates meet.
A card keeps its first digit and gets a valid check digit, a ``+`` number
keeps its first digit.  Only the lengths of IP addresses change: an address is
its four octets, however they are padded.  E-mail addresses have no numeric
format: they become ``u<12 hex digits>`` of the keyed hash, at
``redacted.invalid``.

Everything is SQL functions: rows are rewritten where they stand, without a
shuffle, and rows without a digit or ``@`` skip the work.

Defined results: a null text stays null with 0 finds; an empty text stays
empty; extra columns are kept, columns that clash with an output name are
replaced; repeated rows are rewritten alike; an empty table gives no rows.
A ``/`` date whose first number can be a month is read month first.
"""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
WALKS = 24  # a walk leaves the square's margin (under 2 % of it) at each step

# a domain ends with the letters that begin its last label of two letters or more; possessive
# groups are loops in Java's regex, others a call a label, which overflow the stack
EMAIL = (r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]"
         r"(?:[A-Za-z0-9-]*+(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+\.[A-Za-z]{2,}+)++")
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DAY = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./])\d{1,2}([./])\d{1,2}\1\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)"
         r"|(?<![\d-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\d-])")
CARD = r"(?<!\d)(?:\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5}|\d{13,19})(?!\d)"
PATTERN = "|".join((EMAIL, IP, DAY, SSN, PHONE, CARD))

FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
YEARS = LAST_DAY.year - FIRST_DAY.year + 1
SSNS = 898 * 99 * 9999  # areas 001-899 without 666, groups 01-99, serials 0001-9999


def _side(size: int) -> int:
    return math.isqrt(size - 1) + 1


def _permute(index: Column, size: Column, side: Column, tweak: Column, key: str, inside=None) -> Column:
    """Keyed permutation of the numbers in 0 .. size-1 (side * side >= size)
    for which ``inside`` holds (a function of a column; all, if None)."""
    member = (lambda x: x < size) if inside is None else (lambda x: (x < size) & inside(x))

    def once(x: Column) -> Column:
        def turn(s: Column, r: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r, s["b"]), 256)
            f = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
            return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(f, side), side).alias("b"))

        halves = F.struct(F.call_function("div", x, side).alias("a"), F.pmod(x, side).alias("b"))
        return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), halves, turn, lambda s: s["a"] * side + s["b"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(index),
                       lambda x, _: F.when(member(x), x).otherwise(once(x)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Digit sum from the right; positions with remainder ``doubled`` mod 2 count double."""
    rev = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = rev.substr(i, F.lit(1)).cast("int")
        two = d * 2
        return total + F.when(i % 2 == doubled, two - F.when(two > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add)


def _fill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    def put(s: Column, ch: Column) -> Column:
        is_digit = ch.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, digits.substr(s["at"], F.lit(1))).otherwise(ch)).alias("out"),
                        (s["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.split(form, ""), start, put, lambda s: s["out"])


def _power_of_ten(n: Column, f) -> Column:
    return F.element_at(F.array(*[F.lit(f(10 ** i)).cast("long") for i in range(1, 19)]), F.greatest(n, F.lit(1)))


def _kind(m: Column) -> Column:
    d = F.length(_digits(m))
    octets = F.split(m, r"\.")
    part = F.split(m, r"[./]")
    area = F.substring(m, 1, 3).cast("int")
    month_first = F.try_to_date(m, "M/d/yyyy")
    real = lambda day: day.between(F.lit(FIRST_DAY), F.lit(LAST_DAY))
    return (F.when(m.contains("@"), "email")
            .when(m.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"),
                  F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
            .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.when(real(F.try_to_date(m, "yyyy-MM-dd")), "iso"))
            .when(m.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
                  F.when(real(month_first), "mdy").when(real(F.try_to_date(m, "d/M/yyyy")), "dmy/"))
            .when(m.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$") & (F.size(part) == 3),
                  F.when(real(F.try_to_date(m, "d.M.yyyy")), "dmy."))
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"),
                  F.when(area.between(1, 899) & (area != 666) & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"), "ssn"))
            .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), F.when(d.between(7, 15), "phone"))
            .when(_luhn_sum(_digits(m), 0) % 10 == 0, "card"))


def _date(m: Column, kind: Column) -> tuple[Column, Column, Column, Column]:
    """(year, month, day, least day) of a date candidate, the first three as written."""
    part = F.split(m, "[./-]")
    year = F.get(part, F.when(kind == "iso", 0).otherwise(2))
    month = F.get(part, F.when(kind == "mdy", 0).otherwise(1))
    day = F.get(part, F.when(kind == "iso", 2).when(kind == "mdy", 1).otherwise(0))
    return year, month, day, F.when(kind == "dmy/", 13).otherwise(1)


def _calendar_day(x: Column, days: Column, least: Column, months: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) number ``x`` of a date format: years of ``months`` of ``days``."""
    div = lambda a, b: F.call_function("div", a, b)
    return div(x, months * days) + FIRST_DAY.year, F.pmod(div(x, days), months) + 1, F.pmod(x, days) + least


def _exists(year: Column, month: Column, day: Column) -> Column:
    leap = (F.pmod(year, F.lit(4)) == 0) & (year != 1900)
    return day <= F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def _located(s: Column) -> Column:
    """struct(text, kind, width, index, size, side, days, least, months) of a
    candidate and its kind; the last three for dates only."""
    m, kind = s["text"], s["kind"]
    digits = _digits(m)
    plus = m.startswith("+")
    body = F.when(kind == "card", digits.substr(F.lit(2), F.length(digits) - 2)).when(plus, F.substring(digits, 2, 20)).otherwise(digits)
    octets = F.split(m, r"\.")
    area = F.substring(m, 1, 3).cast("long")
    area = area - F.when(area > 666, 2).otherwise(1)
    dated = kind.isin("iso", "mdy", "dmy/", "dmy.")
    year, month, day, least = _date(m, kind)
    months = F.when(F.length(month) == 1, 9).otherwise(12).cast("long")
    days = (F.when(F.length(day) == 1, 9).otherwise(31) - least + 1).cast("long")
    index = (F.when(kind == "ip", F.aggregate(octets, F.lit(0).cast("long"), lambda t, o: t * 256 + o.cast("long")))
             .when(dated, ((year.try_cast("long") - FIRST_DAY.year) * months + month.try_cast("long") - 1) * days
                   + day.try_cast("long") - least)
             .when(kind == "ssn", (area * 99 + F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1)
             .when(kind.isin("phone", "card"), body.cast("long")))
    width = F.length(body)

    def by_kind(f, of_date):
        return (F.when(kind == "ip", F.lit(f(2 ** 32)).cast("long")).when(dated, of_date)
                .when(kind == "ssn", F.lit(f(SSNS)).cast("long"))
                .when(kind.isin("phone", "card"), _power_of_ten(width, f)))  # others can have more digits than a long

    dates = YEARS * months * days
    only = lambda c: F.when(dated, c.cast("long"))
    return F.struct(m.alias("text"), kind.alias("kind"), width.alias("width"), index.alias("index"),
                    by_kind(lambda n: n, dates).alias("size"), by_kind(_side, F.ceil(F.sqrt(dates.cast("double")))).alias("side"),
                    only(days).alias("days"), only(least).alias("least"), only(months).alias("months"))


def _written(s: Column, key: str) -> Column:
    """The pseudonym of a permuted candidate (the text itself if not valid)."""
    m, kind, x = s["text"], s["kind"], s["index"]
    digits = _digits(m)
    body = F.lpad(x.cast("string"), s["width"], "0")
    _, old_month, old_day, _ = _date(m, kind)
    year, month, day = _calendar_day(x, s["days"], s["least"], s["months"])
    year = year.cast("string")
    month = F.lpad(month.cast("string"), F.length(old_month), "0")
    day = F.lpad(day.cast("string"), F.length(old_day), "0")
    whole = F.concat(F.substring(digits, 1, 1), body)
    check = F.pmod(-_luhn_sum(whole, 1), F.lit(10)).cast("string")
    octet = lambda k: F.pmod(F.shiftright(x, k), F.lit(256)).cast("string")
    area = F.call_function("div", x, F.lit(99 * 9999).cast("long")) + 1
    area = area + F.when(area >= 666, 1).otherwise(0)
    group = F.pmod(F.call_function("div", x, F.lit(9999).cast("long")), F.lit(99)) + 1
    ssn = F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"),
                      F.lpad((F.pmod(x, F.lit(9999)) + 1).cast("string"), 4, "0"))
    return (F.when(kind.isNull(), m)
            .when(kind == "email", F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key + "|email|"), F.lower(m)), 256), 1, 12),
                                            F.lit("@redacted.invalid")))
            .when(kind == "ip", F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)))
            .when(kind == "iso", F.concat_ws("-", year, month, day))
            .when(kind == "mdy", F.concat_ws("/", month, day, year))
            .when(kind == "dmy/", F.concat_ws("/", day, month, year))
            .when(kind == "dmy.", F.concat_ws(".", day, month, year))
            .when(kind == "ssn", ssn)
            .when(kind == "card", _fill(m, F.concat(whole, check)))
            .when(m.startswith("+"), _fill(m, whole))
            .otherwise(_fill(m, body)))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, plus ``n_pseudonyms`` (values
    replaced) and ``found_kinds`` (their kinds, in text order)."""
    t = F.col(f"`{text}`")
    busy = t.rlike("[0-9@]")
    found = F.when(busy, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    made = ("n_pseudonyms", "found_kinds", "__found")
    kept = [c for c in docs.columns if c not in made]
    d = docs.select(*[F.col(f"`{c}`") for c in kept], found.alias("__found"))
    tweak = lambda s: F.concat_ws("|", s["kind"], s["size"])
    known = F.transform("__found", lambda m: F.struct(m.alias("text"), _kind(m).alias("kind")))
    real = lambda s: lambda x: s["days"].isNull() | _exists(*_calendar_day(x, s["days"], s["least"], s["months"]))
    placed = F.transform(F.transform(known, _located), lambda s: F.struct(
        *[s[c].alias(c) for c in ("text", "kind", "width", "days", "least", "months")],
        F.when(s["index"].isNotNull(), _permute(s["index"], s["size"], s["side"], tweak(s), key, real(s))).alias("index")))
    d = d.withColumn("__found", F.when(F.size("__found") > 0, placed))
    new = F.transform("__found", lambda s: _written(s, key))
    gaps = F.split(t, PATTERN, -1)
    rebuilt = F.array_join(F.zip_with(gaps, new, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    kinds = F.coalesce(F.transform(F.filter("__found", lambda s: s["kind"].isNotNull()), lambda s: s["kind"]),
                       F.array().cast("array<string>"))
    return d.select(*[F.when(F.col("__found").isNotNull(), rebuilt).otherwise(t).alias(c) if c == text else F.col(f"`{c}`")
                      for c in kept], F.size(kinds).alias("n_pseudonyms"), kinds.alias("found_kinds"))
