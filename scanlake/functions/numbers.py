"""Percentages with one digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_digit_text(x: Column | str) -> Column:
    """The exact binary value to one digit, ties to even, without digit grouping."""
    return F.call_function("format_number", F.col(x) if isinstance(x, str) else x, F.lit("0.0"))


def one_digit(x: Column | str) -> Column:
    """As a number (``round`` works on the decimal text and differs)."""
    return one_digit_text(x).cast("double")


def percent(num: Column, den: Column, empty: float | None = None) -> Column:
    """``num / den`` as a percentage; ``empty`` where the denominator is 0."""
    ratio = F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0)
    return F.when(den == 0, F.lit(empty).cast("double")).otherwise(one_digit(ratio))


def rate_percent(rate: Column) -> Column:
    """A 0..1 rate, as text or number, as a percentage; null where it is not a number."""
    return one_digit(rate.try_cast("double") * F.lit(100.0))
