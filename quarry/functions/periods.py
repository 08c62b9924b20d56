"""Periods: the tokens YYYY, YYYY-Hn, YYYY-Qn and YYYY-MM, and half-open date ranges."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(\d{4})(?:-(?:H([12])|Q([1-4])|(0[1-9]|1[0-2])))?\s*", re.IGNORECASE)
#: Months of a span and the letter of its token.
SPANS = ((1, ""), (3, "Q"), (6, "H"), (12, "Y"))


def shift(day: date, months: int) -> date:
    at = day.year * 12 + day.month - 1 + months
    return date(at // 12, at % 12 + 1, 1)


def bounds(token: str) -> tuple[date, date] | None:
    """[start, end) of a token; None if it is none."""
    m = _TOKEN.fullmatch(token)
    if not m:
        return None
    year, half, quarter, month = m.groups()
    size = 6 if half else 3 if quarter else 1 if month else 12
    first = (int(half or quarter or month or 1) - 1) * size + 1
    start = date(int(year), first, 1)
    return start, shift(start, size)


def token(start: date, end: date) -> str | None:
    """The token of a range, or None for a span that has none."""
    if start.day != 1:
        return None
    for size, letter in SPANS:
        if shift(start, size) == end and (start.month - 1) % size == 0:
            part = (start.month - 1) // size + 1
            return f"{start.year}" if letter == "Y" else f"{start.year}-{letter}{part}" if letter else f"{start.year}-{part:02d}"
    return None


def canonical(text: str) -> str | None:
    found = bounds(text)
    return token(*found) if found else None


def start_column(tokens: Column) -> Column:
    t = F.upper(F.trim(tokens))
    year = F.regexp_extract(t, r"^(\d{4})", 1).try_cast("int")
    part = F.regexp_extract(t, r"-[HQ]?(\d+)$", 1).try_cast("int")
    month = F.when(t.rlike(r"^\d{4}$"), 1).when(t.rlike(r"^\d{4}-H[12]$"), (part - 1) * 6 + 1).when(t.rlike(r"^\d{4}-Q[1-4]$"), (part - 1) * 3 + 1).when(t.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), part)
    return F.when(month.isNotNull(), F.make_date(year, month, F.lit(1)))


def end_column(tokens: Column) -> Column:
    t = F.upper(F.trim(tokens))
    size = F.when(t.rlike(r"^\d{4}$"), 12).when(t.rlike("-H"), 6).when(t.rlike("-Q"), 3).otherwise(1)
    return F.add_months(start_column(tokens), size)


def token_column(day: Column, kind: str) -> Column:
    """Token of the year, half, quarter or month that a date is in."""
    if kind == "year":
        return F.date_format(day, "yyyy")
    if kind == "half":
        return F.concat(F.date_format(day, "yyyy"), F.lit("-H"), F.when(F.month(day) <= 6, "1").otherwise("2"))
    if kind == "quarter":
        return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))
    return F.date_format(day, "yyyy-MM")


def cutoff(rule: str, period_end: Column) -> Column:
    """Last day that a report counts: month_end stands for the period's last day, else a date."""
    return F.date_sub(period_end, 1) if rule == "month_end" else F.lit(rule).cast("date")
