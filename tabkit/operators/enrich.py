"""A dated series resampled to months and joined on by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import month_key, round_even
from .profile import as_day

RATE = "mortgage_rate_30yr"


def series_range(series: DataFrame, date: str = "date", value: str = RATE) -> DataFrame:
    """One row: observations, first and last date, lowest and highest value."""
    return series.agg(
        F.count("*").alias("observations"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def resample_monthly(
    series: DataFrame, date: str = "date", value: str = RATE, digits: int = 4, scale: int = 12
) -> DataFrame:
    """Rows (year_month, value): monthly means; months without observation inside the range are null.

    Values are summed as decimals with ``scale`` places, which must be ``digits`` at least: a mean that lands on a
    rounding tie must not depend on the order in which partitions are added up. A value with a bad date fails the job:
    left out, it would change a month without a trace.
    """
    if scale < digits:
        raise ValueError(f"scale {scale} is less than digits {digits}")
    bad = F.raise_error(F.lit(f"a {value} without a valid {date}"))
    observed = series.where(F.col(value).isNotNull()).select(
        F.when(F.col(date).isNull(), bad).otherwise(F.trunc(date, "MM")).alias("_month"),
        F.col(value).cast(f"decimal(38,{scale})").alias("_value"),
    )
    means = observed.groupBy("_month").agg(
        (F.sum("_value").cast("double") / F.count("*")).alias("_mean")
    )
    span = means.agg(F.min("_month").alias("_first"), F.max("_month").alias("_last")).where("_first is not null")
    calendar = span.select(F.explode(F.expr("sequence(_first, _last, interval 1 month)")).alias("_month"))
    return calendar.join(means, "_month", "left").select(
        month_key("_month").alias("year_month"), round_even("_mean", digits).alias(value)
    )


def _with_month(df: DataFrame, date: str) -> DataFrame:
    """Adds ``year_month``. The day is a column of its own on the way, so that its text is parsed once."""
    return df.withColumn("__day_of_month_key", as_day(df, date)).withColumn("year_month", month_key("__day_of_month_key")).drop("__day_of_month_key")


def enrich_monthly_rate(df: DataFrame, monthly: DataFrame, date: str, value: str = RATE) -> DataFrame:
    """Left join of the monthly series on the month of ``date``; row count is preserved.

    The monthly side has one row per calendar month, at most 120,000 for all years a date can
    hold, so it is safe to broadcast.
    """
    return _with_month(df, date).join(F.broadcast(monthly.select("year_month", value)), "year_month", "left")


def enrich_or_null(df: DataFrame, monthly: DataFrame | None, date: str, value: str = RATE) -> DataFrame:
    """As ``enrich_monthly_rate``; without a series the value column is null and the month key stays."""
    if monthly is not None:
        return enrich_monthly_rate(df, monthly, date, value)
    return _with_month(df, date).withColumn(value, F.lit(None).cast("double"))
