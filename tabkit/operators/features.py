"""Derived price and time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip, month_key, month_number, quotient, round_even, year_number


def guarded_ratio(
    numerator: Column | str,
    denominator: Column | str,
    min_denominator: float,
    digits: int,
    bounds: tuple[float, float] | None = None,
) -> Column:
    """Rounded ratio where the denominator exceeds the guard, else null; optionally clipped after rounding."""
    below = F.col(denominator) if isinstance(denominator, str) else denominator
    ratio = F.when(below > float(min_denominator), round_even(quotient(numerator, below), digits))
    return clip(ratio, *bounds) if bounds else ratio


def time_parts(df: DataFrame, date: str, year: str, month: str, yrmo: str) -> DataFrame:
    """Year and month as nullable integers, and ``yyyy-MM``."""
    return df.withColumns({year: year_number(date), month: month_number(date), yrmo: month_key(date)})
