"""Exact money arithmetic.

Prices are doubles of up to six decimals; a line is computed from them in ``decimal`` and
each measure is rounded once. The rounded amounts are doubles with two decimals at rest.
Sums of them are taken in whole cents in a ``bigint``: they do not depend on the order of
the rows and stay in generated code. Overflow raises under ANSI, which the jobs pin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(value: Column, factor: int) -> Column:
    """``value * factor`` as the nearest whole number, e.g. cents of an amount."""
    return F.rint(value * F.lit(factor)).cast("bigint")


def exact(value: Column, name: str) -> Column:
    """The decimal number a double was written as; more than six decimals are an error."""
    number = value.cast("decimal(18,6)")
    too_fine = F.raise_error(F.concat(F.lit(f"more than 6 decimals in {name}: "), value.cast("string")))
    return F.when(number.cast("double") != value, too_fine.cast("decimal(18,6)")).otherwise(number)


def rounded(number: Column) -> Column:
    """An exact number as an amount, rounded half away from zero."""
    return F.round(number, 2).cast("double")


def cents(amount: Column) -> Column:
    return scaled(amount, 100)


def amount(whole_cents: Column) -> Column:
    """Cents back to a double, the one nearest the exact amount below 2**53 cents."""
    return whole_cents.cast("double") / F.lit(100.0)


def half_up_div(numerator: Column, denominator: Column) -> Column:
    """Integer quotient rounded half away from zero; null where the denominator is 0."""
    size, by = F.abs(numerator), F.abs(denominator)
    quotient = F.call_function("div", F.lit(2) * size + by, F.nullif(F.lit(2) * by, F.lit(0)))
    return F.when((numerator < 0) != (denominator < 0), -quotient).otherwise(quotient)
