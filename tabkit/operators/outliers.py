"""Interquartile-range fences, flags and filters.

Fences are computed once on the executors and reach the rows as literals, two numbers per
field: no join, no second computation when a flagged frame is used several times, and a
filter by fences can be pushed down to the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_true, round_even
from ..session import cut_lineage
from .distribution import distribution
from .flags import any_of


FENCE_PROBABILITIES = [0.25, 0.75]


def iqr_fences(df: DataFrame, fields: Sequence[str], k: float = 1.5, **limits: int) -> DataFrame:
    """Rows (field, q1, q3, iqr, lower, upper); absent fields and fields without values are skipped."""
    fields = [f for f in fields if f in df.columns]
    if not fields:
        return df.sparkSession.createDataFrame(
            [], "field string, q1 double, q3 double, iqr double, lower double, upper double"
        )
    return fences_of(distribution(df, fields, FENCE_PROBABILITIES, means=False, **limits), k)


def fences_of(stats: DataFrame, k: float = 1.5) -> DataFrame:
    """The fences from rows (field, quantiles) whose quantiles are those of ``FENCE_PROBABILITIES``."""
    quartiles = stats.select("field", F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("q3"))
    return quartiles.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns(
        {"lower": F.col("q1") - k * F.col("iqr"), "upper": F.col("q3") + k * F.col("iqr")}
    )


def fence_bounds(fences: DataFrame) -> dict[str, tuple[float, float]]:
    """field -> (lower, upper); one row per field comes to the driver."""
    return {r["field"]: (r["lower"], r["upper"]) for r in fences.select("field", "lower", "upper").collect()}


def outlier_flags(
    df: DataFrame, fields: Sequence[str], k: float = 1.5, fences: DataFrame | None = None, **limits: int
) -> DataFrame:
    """Adds ``<field>_outlier_flag``; all fences come from the whole frame and no row is removed.

    Absent fields and fields without any value get no flag.
    """
    bounds = fence_bounds(iqr_fences(df, fields, k, **limits) if fences is None else fences)
    return df.withColumns(
        {
            f"{f}_outlier_flag": is_true((F.col(f) < bounds[f][0]) | (F.col(f) > bounds[f][1]))
            for f in fields
            if f in bounds
        }
    )


def keep_inside(df: DataFrame, field: str, lower: float, upper: float) -> DataFrame:
    """Rows inside the closed interval; null rows fall out."""
    return df.where(F.col(field).between(lower, upper))


def iqr_filter_sequential(df: DataFrame, fields: Sequence[str], k: float = 1.5, staged: bool = False, **limits: int) -> DataFrame:
    """Remove outliers field by field: each fence is computed on the rows the previous fences left.

    The fields alone are checkpointed first, so that ``df`` is computed once for all fences and once for its rows. ``staged`` says that it is
    a written table already.
    """
    present = [f for f in fields if f in df.columns]
    values = df if staged or not present else cut_lineage(df.select(*present))
    for field in fields:
        bounds = fence_bounds(iqr_fences(values, [field], k, **limits))
        if field not in bounds:
            # A field without any value compares with nothing, and all its rows fall out.
            return df.where(F.lit(False))
        df, values = keep_inside(df, field, *bounds[field]), keep_inside(values, field, *bounds[field])
    return df


def median_shift(df: DataFrame, fields: Sequence[str], flags: Sequence[str], digits: int = 2, **limits: int) -> DataFrame:
    """Rows (field, median_before, median_after, shift): medians of all rows and of unflagged rows."""
    fields = [f for f in fields if f in df.columns]
    kept = ~any_of(df, flags)
    both = df.select(
        *[F.col(f).alias(f"before {f}") for f in fields],
        *[F.when(kept, F.col(f)).alias(f"after {f}") for f in fields],
    )
    stats = distribution(both, both.columns, [0.5], means=False, **limits).select(
        F.split("field", " ", 2).alias("part"), F.col("quantiles")[0].alias("median")
    )

    def of(side: str) -> Column:
        return F.max(F.when(F.col("part")[0] == side, F.col("median")))

    shifted = stats.groupBy(F.col("part")[1].alias("field")).agg(of("before").alias("b"), of("after").alias("a"))
    return shifted.select(
        "field",
        round_even("b", digits).alias("median_before"),
        round_even("a", digits).alias("median_after"),
        round_even(F.col("a") - F.col("b"), digits).alias("shift"),
    )
