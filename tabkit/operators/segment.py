"""Per-segment medians and ordered reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distribution import distribution
from .profile import padded


def segment_summary(
    df: DataFrame,
    key: str,
    medians: Mapping[str, str],
    count_of: str,
    count_name: str = "count",
    **limits: int,
) -> DataFrame:
    """Per segment: non-null count of ``count_of`` and the median of each given column.

    ``medians`` maps output names to columns; columns the frame lacks are left out. A segment
    whose values are all null keeps its row; rows without a segment are dropped. Without the segment
    column the report is empty; a ``count_of`` that the frame lacks counts as null.
    """
    medians = {name: c for name, c in medians.items() if c in df.columns}
    if key not in df.columns:
        empty = [f"cast(null as string) as `{key}`", f"cast(null as bigint) as `{count_name}`"]
        return df.where(F.lit(False)).selectExpr(*empty, *[f"cast(null as double) as `{m}`" for m in medians])
    columns = list(dict.fromkeys([*medians.values(), count_of]))
    narrow = padded(df, [count_of]).select(key, *columns)
    stats = distribution(narrow, columns, [0.5], keys=[key], keep_empty=True, means=False, **limits)
    return segments_of(stats, key, medians, count_of, count_name)


def segments_of(stats: DataFrame, key: str, medians: Mapping[str, str], count_of: str, count_name: str = "count") -> DataFrame:
    """The summary from rows of ``distribution`` by the key, empty groups kept, whose quantiles are the medians."""

    def of(column: str, value):
        return F.max(F.when(F.col("field") == column, value))

    return stats.groupBy(key).agg(
        F.coalesce(of(count_of, F.col("count")), F.lit(0)).alias(count_name),
        *[of(c, F.col("quantiles")[0]).alias(name) for name, c in medians.items()],
    )


def group_center(
    df: DataFrame, key: str, value: str, median_name: str = "median", count_name: str = "count", **limits: int
) -> DataFrame:
    """Per group: median and non-null count of one column."""
    summary = segment_summary(df, key, {median_name: value}, value, count_name, **limits)
    return summary.select(key, median_name, count_name)


def order_by_desc(df: DataFrame, by: str, tie: str | Sequence[str]) -> DataFrame:
    """Highest first, nulls last, ties in the order of the tie columns; without ``by`` in their order only."""
    ties = [tie] if isinstance(tie, str) else list(tie)
    first = [F.col(by).desc_nulls_last()] if by in df.columns else []
    return df.orderBy(*first, *ties)


def top_k(df: DataFrame, by: str, tie: str | Sequence[str], k: int = 10) -> DataFrame:
    return order_by_desc(df, by, tie).limit(k)


def last_k(df: DataFrame, by: str, k: int = 6) -> DataFrame:
    """The k rows with the greatest ``by``, for example the last six months."""
    return df.orderBy(F.desc(by)).limit(k)


def group_total(groups: DataFrame) -> DataFrame:
    """Number of groups of a per-group table."""
    return groups.agg(F.count("*").alias("groups"))


def sample_rows(df: DataFrame, columns: Sequence[str], order: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows in an explicit order, so that every run shows the same rows."""
    return df.orderBy(*order).select(*[c for c in columns if c in df.columns]).limit(n)
