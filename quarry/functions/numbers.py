"""Amounts: formatting, parsing with units, closeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of amounts in reports and their factors.
UNITS = {"亿元": 100_000_000, "万元": 10_000, "千元": 1_000, "亿": 100_000_000, "万": 10_000, "千": 1_000, "元": 1}
AMOUNT = r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)\s*(亿元|万元|千元|亿|万|千|元)"


def in_ten_thousands(amount: Column) -> Column:
    """Two decimals in units of 10,000."""
    return F.format_number(F.round(amount / 10_000, 2), 2)


def percent(part: Column, base: Column, digits: int = 1) -> Column:
    """A share in percent; a dash where there is no base."""
    return F.when(F.coalesce(base, F.lit(0)) == 0, "—").otherwise(F.concat(F.format_number(F.round(100.0 * part / F.nullif(base, F.lit(0)), digits), digits), F.lit("%")))


def signed_delta(now: Column, before: Column) -> Column:
    change = F.round(100.0 * (now - before) / F.nullif(F.abs(before), F.lit(0)), 1)
    return F.when(F.coalesce(before, F.lit(0)) == 0, "—").otherwise(F.concat(F.when(change >= 0, "+").otherwise(""), F.format_number(change, 1), F.lit("%")))


def amounts(text: Column) -> Column:
    """All amounts in a text, in base units."""
    found = F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0))

    def value(x: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(x, AMOUNT, 1), ",", "").cast("double")
        unit = F.regexp_extract(x, AMOUNT, 2)
        factor = F.lit(1.0)
        for name, f in UNITS.items():
            factor = F.when(unit == name, F.lit(float(f))).otherwise(factor)
        return F.round(number * factor, 4)

    return F.transform(found, value)


def close(a: Column, b: Column, share: float = 0.001) -> Column:
    return F.abs(a - b) <= share * F.abs(b)


def tolerance(base: Column) -> Column:
    """What two sources may differ by: one unit, or a thousandth."""
    return F.greatest(F.lit(1.0), 0.001 * F.abs(base))
