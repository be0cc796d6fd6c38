"""SQL fragments for the DuckDB oracle queries.

The oracle is written independently of the Spark code: plain ANSI/DuckDB
SQL over the registered views.  These helpers only keep the repeated parts
(holiday rules, output normalisation) in one place.
"""

from __future__ import annotations

import math

DIGITS = 6

# Holiday rules (same calendar as demandlake.functions.calendar).
_RULES = (
    ("New Year's Day", "month({d}) = 1 AND day({d}) = 1"),
    ("Martin Luther King Jr. Day", "month({d}) = 1 AND isodow({d}) = 1 AND day({d}) BETWEEN 15 AND 21"),
    ("Washington's Birthday", "month({d}) = 2 AND isodow({d}) = 1 AND day({d}) BETWEEN 15 AND 21"),
    ("Memorial Day", "month({d}) = 5 AND isodow({d}) = 1 AND day({d}) >= 25"),
    ("Juneteenth National Independence Day", "month({d}) = 6 AND day({d}) = 19 AND year({d}) >= 2021"),
    ("Independence Day", "month({d}) = 7 AND day({d}) = 4"),
    ("Labor Day", "month({d}) = 9 AND isodow({d}) = 1 AND day({d}) <= 7"),
    ("Thanksgiving Day", "month({d}) = 11 AND isodow({d}) = 4 AND day({d}) BETWEEN 22 AND 28"),
    ("Christmas Day", "month({d}) = 12 AND day({d}) = 25"),
)
_BATCH = {"New Year's Day", "Washington's Birthday", "Memorial Day", "Independence Day",
          "Labor Day", "Christmas Day"}


def holiday_name(d: str) -> str:
    parts = " ".join(f"WHEN {cond.format(d=f'({d})')} THEN '{name.replace(chr(39), chr(39) * 2)}'"
                     for name, cond in _RULES)
    return f"(CASE {parts} END)"


def is_holiday(d: str, names: str = "all_nine") -> str:
    rules = _RULES if names == "all_nine" else [r for r in _RULES if r[0] in _BATCH]
    cond = " OR ".join(f"({c.format(d=f'({d})')})" for _, c in rules)
    return f"(CASE WHEN {d} IS NOT NULL AND ({cond}) THEN 1 ELSE 0 END)"


def cyc(x: str, period: int, fn: str) -> str:
    return f"{fn}(CAST({x} AS DOUBLE) * {2 * math.pi / period!r})"


def dbl(x: str, digits: int = DIGITS) -> str:
    scale = f"CAST({float(10 ** digits)!r} AS DOUBLE)"
    return f"(round_even(CAST({x} AS DOUBLE) * {scale}, 0) / {scale} + 0.0)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def day(x: str) -> str:
    return f"strftime(CAST({x} AS DATE), '%Y-%m-%d')"


def tstr(x: str) -> str:
    return f"strftime(CAST({x} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"


def select(inner: str, cols: dict[str, str]) -> str:
    """``SELECT f(col) AS col ...`` over ``inner``; kinds: d(ouble), i(nt),
    day, ts, s(tring, untouched)."""
    out = []
    for name, kind in cols.items():
        q = f'"{name}"'
        if kind == "day":
            expr = day(q)
        elif kind.startswith("d"):
            digits = int(kind[1:]) if len(kind) > 1 else DIGITS
            expr = dbl(q, digits)
        elif kind == "i":
            expr = big(q)
        elif kind == "ts":
            expr = tstr(q)
        else:
            expr = q
        out.append(f"{expr} AS {q}")
    return f"SELECT {', '.join(out)} FROM (\n{inner}\n) AS _q"
