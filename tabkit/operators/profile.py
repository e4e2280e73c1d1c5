"""Reports on a frame: missing values, numeric profiles, frequencies and date checks.

Every report is one aggregation over the columns it needs; rows of the report are
unfolded from the single result row, never from one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_true, num, percent_of, quotient, round_even, to_day
from .distribution import distribution

PROFILE_PROBABILITIES = [0.25, 0.5, 0.75, 0.9, 0.99]


def select_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(n) for n in names if n in df.columns])


def padded(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame with a null column for each name it lacks."""
    return df.withColumns({n: F.lit(None).cast("double") for n in names if n not in df.columns})


def text_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


#: What the values of a text column can be, from narrow to wide; a column without values is a number, as nothing speaks against it.
KINDS = ["double", "bigint", "double", "string"]


def inferred_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """The narrowest type that all values of each text column have: bigint, double or string. One aggregate over all rows; one row comes to the driver."""
    columns = [c for c, kind in df.dtypes if kind == "string" and (columns is None or c in columns)]
    if not columns:
        return {}

    def kind(name: str) -> Column:
        value = F.col("`" + name.replace("`", "``") + "`")
        whole = value.rlike(r"^[+-]?[0-9]+$") & value.try_cast("bigint").isNotNull()
        return F.when(value.isNull(), 0).when(whole, 1).when(num(value).isNotNull(), 2).otherwise(3)

    found = df.agg(*[F.coalesce(F.max(kind(c)), F.lit(0)).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    return {c: KINDS[found[i]] for i, c in enumerate(columns)}


def with_inferred_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns cast to the type that all their values have (see ``inferred_types``)."""
    types = inferred_types(df, columns)
    cells = []
    for c in df.columns:
        value = F.col("`" + c.replace("`", "``") + "`")
        cells.append({"bigint": value.try_cast("bigint"), "double": num(value)}.get(types.get(c), value).alias(c))
    return df.select(*cells)


def as_numbers(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields that exist, text among them coerced to double."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            (num(F.col(f)) if kinds[f] == "string" else F.col(f).cast("double")).alias(f)
            for f in fields
            if f in kinds
        ]
    )


def as_day(df: DataFrame, name: str) -> Column:
    """The column as a date, whether it still is text or already typed; null where the frame lacks it."""
    if name not in df.columns:
        return F.lit(None).cast("date")
    return to_day(F.col(name)) if dict(df.dtypes)[name] == "string" else F.to_date(F.col(name))


def unfold(one_row: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate into report rows, one per entry of ``rows``, one at least."""
    entries = F.array(*[F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows])
    return one_row.select(F.inline(entries))


def describe_schema(df: DataFrame) -> DataFrame:
    """Rows (position, column, type, rows, columns)."""
    counted = df.agg(F.count("*").alias("n"))
    rows = [
        [F.lit(i + 1), F.lit(name), F.lit(kind), F.col("n"), F.lit(len(df.columns))]
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return unfold(counted, rows, ["position", "column", "type", "rows", "columns"])


def file_row_counts(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows per input file. Works on any frame that carries the file name in ``source``."""
    return df.groupBy(source).agg(F.count("*").alias("rows"))


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null kept as a value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def missing_counts(columns: Sequence[str]) -> dict[str, Column]:
    """The aggregates that a missing-value report is made of."""
    return {"_rows": F.count("*"), **{c: F.count_if(F.col("`" + c.replace("`", "``") + "`").isNull()) for c in columns}}


def missing_from(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The report from one row of ``missing_counts``."""
    cells = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
    report = counts.unpivot("_rows", cells, "column", "missing_count")
    return report.select(
        "column", "missing_count", round_even(percent_of("missing_count", "_rows"), 2).alias("missing_pct")
    ).orderBy(F.desc("missing_pct"), "column")


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (column, missing_count, missing_pct), worst first. The percentage is rounded to 2 digits."""
    columns = list(df.columns if columns is None else columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, missing_count long, missing_pct double")
    return missing_from(df.agg(*[c.alias(name) for name, c in missing_counts(columns).items()]), columns)


def numeric_profile(df: DataFrame, fields: Sequence[str], digits: int = 2, **limits: int) -> DataFrame:
    """Rows (field, count, min, p25, median, mean, p75, p90, p99, max), a field without values skipped."""
    numbers = as_numbers(df, fields)
    return profile_of(distribution(numbers, numbers.columns, PROFILE_PROBABILITIES, **limits), digits)


def profile_of(stats: DataFrame, digits: int = 2) -> DataFrame:
    """The profile from rows of ``distribution`` whose quantiles are those of ``PROFILE_PROBABILITIES``."""
    q = F.col("quantiles")
    measures = {
        "min": F.col("min"),
        "p25": q[0],
        "median": q[1],
        "mean": F.col("mean"),
        "p75": q[2],
        "p90": q[3],
        "p99": q[4],
        "max": F.col("max"),
    }
    return stats.select("field", "count", *[round_even(c, digits).alias(n) for n, c in measures.items()])


def value_distribution(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Count, min, median, mean, p75, p90, p99 and max of one column."""
    profile = numeric_profile(df, [column], digits)
    return profile.select("count", "min", "median", "mean", "p75", "p90", "p99", "max")


def center_and_skew(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Median, mean and mean minus median of one column."""
    numbers = as_numbers(df, [column])
    stats = distribution(numbers, numbers.columns, [0.5])
    median = F.col("quantiles")[0]
    return stats.select(
        round_even(median, digits).alias("median"),
        round_even(F.col("mean"), digits).alias("mean"),
        round_even(F.col("mean") - median, digits).alias("mean_minus_median"),
    )


def category_share(df: DataFrame, column: str, value: str, digits: int = 1) -> DataFrame:
    """Rows of one category against all others (null counts as other), with percentages."""
    counted = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(column) == value).alias("in_category"),
    ).withColumn("other", F.col("total") - F.col("in_category"))
    return counted.select(
        "total",
        "in_category",
        round_even(percent_of("in_category", "total"), digits).alias("in_category_pct"),
        "other",
        round_even(percent_of("other", "total"), digits).alias("other_pct"),
    )


def valid_pair(df: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """Rows with both values present and a positive denominator."""
    return df.where(F.col(numerator).isNotNull() & (F.col(denominator) > 0))


def _three_way(df: DataFrame, value: Column, names: Sequence[str], digits: int, *extra: Column) -> DataFrame:
    """Counts and shares of a value above, at and below a pivot given as -1, 0, 1."""
    above, at, below = names
    counted = df.select(value.alias("_side"), *extra).agg(
        F.count("*").alias("valid"),
        F.count_if(F.col("_side") > 0).alias(above),
        F.count_if(F.col("_side") == 0).alias(at),
        F.count_if(F.col("_side") < 0).alias(below),
        # Amounts have two digits: as decimals their sum does not depend on the order of partitions.
        *[
            (F.sum(F.when(F.col("_side") > 0, F.col("_amount").cast("decimal(28,2)"))).cast("double") / F.nullif(F.count_if(F.col("_side") > 0), F.lit(0))).alias("_mean")
            for _ in extra
        ],
    )
    shares = [c for n in names for c in (F.col(n), round_even(percent_of(n, "valid"), digits).alias(f"{n}_pct"))]
    return counted.select("valid", *shares, *["_mean" for _ in extra])


def above_at_below(df: DataFrame, a: str, b: str, digits: int = 1) -> DataFrame:
    """How often the unrounded ratio a / b is above, at and below one."""
    side = F.signum(quotient(a, b) - 1.0)
    return _three_way(valid_pair(padded(df, [a, b]), a, b), side, ["above", "at", "below"], digits)


def price_change_buckets(df: DataFrame, original: str, current: str, digits: int = 1) -> DataFrame:
    """How often a price was reduced, kept or raised.

    The change is compared after rounding to 0.01%, so a smaller cut counts as unchanged.
    """
    change = round_even(quotient(F.col(original) - F.col(current), F.col(original)) * 100.0, 2)
    buckets = _three_way(
        valid_pair(padded(df, [current, original]), current, original),
        change,
        ["reduced", "unchanged", "raised"],
        digits,
        change.alias("_amount"),
    )
    return buckets.withColumn("mean_reduction_pct", round_even(F.col("_mean"), digits)).drop("_mean")


def date_order_counts(df: DataFrame, close: str, listing: str, purchase: str, digits: int = 2) -> DataFrame:
    """Closings before the listing date and purchases after the closing, among rows with both dates."""
    days = df.select(*[as_day(df, c).alias(n) for c, n in ((close, "c"), (listing, "l"), (purchase, "p"))])
    counted = days.agg(
        F.count_if(F.col("c").isNotNull() & F.col("l").isNotNull()).alias("close_and_listing"),
        F.count_if(F.col("c") < F.col("l")).alias("close_before_listing"),
        F.count_if(F.col("c").isNotNull() & F.col("p").isNotNull()).alias("close_and_purchase"),
        F.count_if(F.col("p") > F.col("c")).alias("purchase_after_close"),
    )
    return counted.select(
        "close_and_listing",
        "close_before_listing",
        round_even(percent_of("close_before_listing", "close_and_listing"), digits).alias("close_before_listing_pct"),
        "close_and_purchase",
        "purchase_after_close",
        round_even(percent_of("purchase_after_close", "close_and_purchase"), digits).alias("purchase_after_close_pct"),
    )


def listing_date_issues(
    df: DataFrame, listing: str, close: str, as_of: str | None = None, digits: int = 2
) -> DataFrame:
    """Closings before the listing date (share of at least one row) and listings after ``as_of``, by default today."""
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    days = df.select(as_day(df, listing).alias("l"), as_day(df, close).alias("c"))
    counted = days.agg(
        F.count_if(F.col("c").isNotNull() & F.col("l").isNotNull()).alias("close_and_listing"),
        F.count_if(F.col("c") < F.col("l")).alias("close_before_listing"),
        F.count_if(F.col("l") > today).alias("listing_in_future"),
    )
    share = percent_of("close_before_listing", F.greatest("close_and_listing", F.lit(1)))
    return counted.select(
        "close_and_listing",
        "close_before_listing",
        round_even(share, digits).alias("close_before_listing_pct"),
        "listing_in_future",
    )


def dataset_span(df: DataFrame, date: str) -> DataFrame:
    """One row: rows, columns, first and last date."""
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.min(as_day(df, date)).alias("first_date"),
        F.max(as_day(df, date)).alias("last_date"),
    )


def key_stats(df: DataFrame, fields: Sequence[str], digits: int = 2) -> DataFrame:
    """Rows (field, median, mean, min, max), a field without values skipped."""
    numbers = as_numbers(df, fields)
    stats = distribution(numbers, numbers.columns, [0.5])
    measures = {"median": F.col("quantiles")[0], "mean": F.col("mean"), "min": F.col("min"), "max": F.col("max")}
    return stats.select("field", *[round_even(c, digits).alias(n) for n, c in measures.items()])


def null_check(df: DataFrame, column: str) -> DataFrame:
    """One row: rows and rows where the column is null, as a check after a join."""
    return padded(df, [column]).agg(F.count("*").alias("rows"), F.count_if(F.col(column).isNull()).alias("null_rows"))


def flag_counts(flags: Sequence[str]) -> dict[str, Column]:
    """The aggregates that a summary of flags is made of."""
    return {"_rows": F.count("*"), **{f: F.count_if(F.col(f"`{f}`")) for f in flags}}


def flags_from(counts: DataFrame, flags: Sequence[str], digits: int = 2) -> DataFrame:
    """The summary from one row of ``flag_counts``."""
    summary = counts.unpivot("_rows", [F.col(f"`{f}`") for f in flags], "flag", "rows")
    return summary.select("flag", "rows", round_even(percent_of("rows", "_rows"), digits).alias("pct"))


def flag_summary(df: DataFrame, flags: Sequence[str], digits: int = 2) -> DataFrame:
    """Rows (flag, rows, pct) for the flags that exist."""
    flags = [f for f in flags if f in df.columns]
    if not flags:
        return df.sparkSession.createDataFrame([], "flag string, rows long, pct double")
    return flags_from(df.agg(*[c.alias(name) for name, c in flag_counts(flags).items()]), flags, digits)
