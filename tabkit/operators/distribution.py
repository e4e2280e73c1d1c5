"""Exact counts, means and interpolated percentiles, per field and per group.

``percentile`` keeps a map of all values of a group in one task, so a group with a
third of all rows breaks it. Here no task ever holds a group:

1. Each value falls into a cell that grows with the value (a step of the logarithm,
   so a cell spans 0.4% of the value). One aggregation, combined on the map side, counts the
   rows of each (group, field, cell). A running sum over the cells, at most a few
   hundred thousand per group and field, tells which cells hold the wanted ranks.
2. A cell whose smallest and largest value are equal is resolved by the histogram alone. Rows of the
   other wanted cells are read again, counted by value and ranked inside the cell.
3. The counted values of a cell with more than ``dense_rows`` rows are held, and first split into 2^22 equal
   steps between the cell's own smallest and largest value; only the steps that hold a wanted
   rank are ranked. A step is so narrow that it holds at most a few million different doubles.

So the input is read twice at most, and once if every wanted cell holds one value.

All counts are exact, so the ranks are exact for any distribution of values. Sums don't depend on the order of rows or partitions either: a
cell's values are of one magnitude, so each is a whole number of the cell's unit, a power of two, and whole numbers are
summed; the cells' sums are added up in the order of the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_CELLS_PER_E_FOLD = 256
# Above 745 * 256, so that cells of tiny positive values stay above zero (ln of the smallest double is -744.4).
_CELL_ORIGIN = 191_000
_STEPS = 1 << 22
DENSE_ROWS = 1 << 22
# Rows of about 100 bytes: a broadcast of 20 MB at most.
BROADCAST_ROWS = 200_000


MEASURES = ["count", "min", "max", "mean", "quantiles"]

# A number that never falls when the value rises: negatives, zero, positives. Written so that it
# cannot be null; else the join on it would compute it a second time to filter nulls.
_CELL = f"""coalesce(cast(case
    when _v > 0 then floor(least(ln(_v), 710D) * {_CELLS_PER_E_FOLD}) + {_CELL_ORIGIN}
    when _v < 0 then -(floor(least(ln(-_v), 710D) * {_CELLS_PER_E_FOLD}) + {_CELL_ORIGIN})
    end as int), 0)"""
_LARGEST = "1.7976931348623157E308D"
# Infinite values stay on the outer steps.
_STEP = f"""case when _high > _low then cast(floor(greatest(-1D, least(2D, (_v - greatest(_low, -{_LARGEST}))
    / (least(_high, {_LARGEST}) - greatest(_low, -{_LARGEST})))) * {_STEPS}) as int) else 0 end"""


# The unit of a cell: its values are 2^52 to 2^54 units, or fewer where the unit would pass the range of doubles. Rounding to units, which
# the smallest values alone need, goes value by value. High and low part keep the sums of 2^36 rows within 64 bits.
_UNITS = f"pow(2D, least(1000D, 52D - floor((abs(_cell) - {_CELL_ORIGIN}) / {_CELLS_PER_E_FOLD}D / ln(2D))))"
_PART = f"{1 << 27}D"
_FINITE = f"(_cell <> 0 and abs(_v) <= {_LARGEST})"
_HIGH_PART = f"case when {_FINITE} then cast(floor(rint(_v * {_UNITS}) / {_PART}) as bigint) end"
_LOW_PART = f"case when {_FINITE} then cast(rint(_v * {_UNITS}) - floor(rint(_v * {_UNITS}) / {_PART}) * {_PART} as bigint) end"
_CELL_SUM = f"""case when abs(_low) > {_LARGEST} or abs(_high) > {_LARGEST} then _low + _high
    else coalesce((_high_sum * {_PART} + _low_sum) / {_UNITS}, 0D) end"""


def _wanted_ranks(probabilities: Sequence[float], start: str, end: str) -> str:
    """The 0-based ranks needed for the probabilities that lie in [start, end)."""
    bounds = ", ".join(
        f"cast({bound}({p!r}D * (_rows - 1)) as bigint)" for p in probabilities for bound in ("floor", "ceil")
    )
    return f"filter(array_distinct(array({bounds})), r -> r >= {start} and r < {end})"


def _quantiles(probabilities: Sequence[float]) -> str:
    """Interpolation between the two ranked values that enclose each probability."""
    return f"""transform(
        transform(array({", ".join(f"{p!r}D" for p in probabilities)}), p -> p * (_rows - 1)),
        x -> case when x = floor(x) then _at[cast(x as bigint)]
            else _at[cast(floor(x) as bigint)] * (1 - (x - floor(x))) + _at[cast(ceil(x) as bigint)] * (x - floor(x)) end)"""


def _long(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per group, field and value; the cell of a missing value is null."""
    key_names = [f"_k{i}" for i in range(len(keys))]
    values = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, key_names)],
        *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(fields)],
    )
    if key_names:
        values = values.dropna(subset=key_names)
    pairs = ", ".join(f"{i}, _f{i}" for i in range(len(fields)))
    # NaN counts as missing, as a null does.
    return values.selectExpr(*key_names, f"stack({len(fields)}, {pairs}) as (_field, _v)").withColumn("_v", F.expr("nullif(_v, double('NaN'))"))


def distribution(
    df: DataFrame,
    fields: Sequence[str],
    probabilities: Sequence[float],
    keys: Sequence[str] = (),
    dense_rows: int = DENSE_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
    keep_empty: bool = False,
    means: bool = True,
) -> DataFrame:
    """Rows (keys..., field, count, min, max, mean, quantiles) over non-null numeric values.

    ``quantiles`` follows the order of ``probabilities``, linearly interpolated. Rows with a
    null key give no row. (Group, field) pairs without any value give no row or, with ``keep_empty``, one
    with count 0. Without fields the result is empty. Without ``means`` nothing is summed, and the mean is null.

    Step 1 runs at once and its picked cells are checkpointed: their number decides whether
    step 2 may broadcast them, and the fullest one whether step 3 is needed.
    """
    if not fields:
        shape = "field string, count long, min double, max double, mean double, quantiles array<double>"
        columns = [f"cast(null as {c.split(' ', 1)[1]}) as {c.split(' ', 1)[0]}" for c in shape.split(", ")]
        return df.where(F.lit(False)).selectExpr(*[f"`{k}`" for k in keys], *columns)
    probabilities = [float(p) for p in probabilities]
    group = [f"_k{i}" for i in range(len(keys))] + ["_field"]
    everything = _long(df, keys, fields)
    values = everything.where("_v is not null").withColumn("_cell", F.expr(_CELL))

    # Step 1: histogram and the cells that hold a wanted rank.
    cells = everything.withColumn("_cell", F.expr(f"if(_v is null, null, {_CELL})")).groupBy(*group, "_cell").agg(
        F.count("_v").alias("_cell_rows"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
        *([F.sum(F.expr(_HIGH_PART)).alias("_high_sum"), F.sum(F.expr(_LOW_PART)).alias("_low_sum")] if means else []),
    )
    cells = cells.withColumn("_sum", F.expr(_CELL_SUM) if means else F.lit(None).cast("double"))
    results = distribution_of_cells(cells, lambda side: values.withColumn("_n", F.lit(1)), group, probabilities, dense_rows, broadcast_rows, keep_empty)
    named = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("_field") + 1)
    return results.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], named.alias("field"), *MEASURES)


def count_values(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows (_k0..., _field, _cell, _v, _n): every value of a group and field with its number of rows; missing ones have a null cell."""
    counted = _long(df, keys, fields).groupBy(*[f"_k{i}" for i in range(len(keys))], "_field", "_v").agg(F.count("*").alias("_n"))
    named = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("_field") + 1)
    return counted.withColumns({"_field": named, "_cell": F.expr(f"if(_v is null, null, {_CELL})")})


def cells_of_counts(counted: DataFrame, group: Sequence[str]) -> DataFrame:
    """The cells of step 1 from counted values."""
    return counted.groupBy(*group, "_cell").agg(
        F.sum(F.expr("if(_v is null, 0, _n)")).alias("_cell_rows"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
        F.sum(F.expr(f"_n * {_HIGH_PART}")).alias("_high_sum"),
        F.sum(F.expr(f"_n * {_LOW_PART}")).alias("_low_sum"),
    )


def add_cells(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """Cells counted apart, such as month by month, as those of all their rows."""
    sums = ["_cell_rows", "_high_sum", "_low_sum"]
    added = cells.groupBy(*group, "_cell").agg(*[F.sum(c).alias(c) for c in sums], F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    return added.withColumn("_sum", F.expr(_CELL_SUM))


def distribution_of_cells(
    cells: DataFrame,
    values_in: Callable[[DataFrame], DataFrame],
    group: Sequence[str],
    probabilities: Sequence[float],
    dense_rows: int,
    broadcast_rows: int,
    keep_empty: bool,
) -> DataFrame:
    """Rows (group..., count, min, max, mean, quantiles) from the cells of step 1.

    ``values_in`` gives rows (group..., _cell, _v, _n) that hold all values of the mixed cells it is given, and maybe others.
    """
    names = ", ".join(group)
    whole = f"over (partition by {names})"
    upto = f"over (partition by {names} order by _cell nulls first rows unbounded preceding)"
    wanted = f"size({_wanted_ranks(probabilities, '_before', '_before + _cell_rows')}) > 0"
    picked = cells.selectExpr(
        *group,
        "_cell",
        "_cell_rows",
        "_low",
        "_high",
        f"sum(_cell_rows) {upto} - _cell_rows as _before",
        f"sum(_cell_rows) {whole} as _rows",
        f"min(_low) {whole} as _min",
        f"max(_high) {whole} as _max",
        f"sum(_sum) over (partition by {names} order by _cell nulls first rows between unbounded preceding and unbounded following) as _total",
    ).where(f"(_cell is not null and {wanted})" + (" or _rows = 0" if keep_empty else ""))
    picked = cut_lineage(picked)
    mixed = picked.where("_low < _high")
    size = mixed.agg(F.count("*").alias("cells"), F.max("_cell_rows").alias("fullest")).first()
    small = size["cells"] <= broadcast_rows

    carried = ["_rows", "_min", "_max", "_total"]
    place = [*group, "_cell", "_before", *carried]
    found = picked.where("_low = _high").selectExpr(
        *group, *carried, "_low as _v", f"explode({_wanted_ranks(probabilities, '_before', '_before + _cell_rows')}) as _rank"
    )

    def ranked(rows: DataFrame, part: Sequence[str], start: str) -> DataFrame:
        """Rows (group, carried, value, rank) for the wanted ranks of each part."""
        upto = f"over (partition by {', '.join(part)} order by _v rows unbounded preceding)"
        return rows.selectExpr(*group, *carried, "_v", "_n", f"{start} + sum(_n) {upto} as _end").selectExpr(
            *group,
            *carried,
            "_v",
            f"explode({_wanted_ranks(probabilities, '_end - _n', '_end')}) as _rank",
        )

    if size["cells"]:
        # Step 2: values of the cells that hold several, with their counts.
        extra = ["_cell_rows", "_low", "_high"]
        side = mixed.select(*place, *extra)
        values = values_in(side)
        if small:
            joined = values.join(F.broadcast(side), [*group, "_cell"])
            counted = joined.groupBy(*place, *extra, "_v").agg(F.sum("_n").alias("_n"))
        else:
            # Counted before the shuffle join, so that a value held by many rows travels once per task.
            once = values.groupBy(*group, "_cell", "_v").agg(F.sum("_n").alias("_n"))
            counted = once.join(side, [*group, "_cell"]).select(*place, *extra, "_v", "_n")
        if size["fullest"] > dense_rows:
            # Step 3: cells too full for one task. Held, as it is used three times.
            counted = cut_lineage(counted)
            dense = counted.where(f"_cell_rows > {dense_rows}").withColumn("_step", F.expr(_STEP))
            counted = counted.where(f"_cell_rows <= {dense_rows}")
            upto = f"over (partition by {names}, _cell order by _step rows unbounded preceding)"
            steps = (
                dense.groupBy(*place, "_step")
                .agg(F.sum("_n").alias("_step_rows"))
                .withColumn("_step_end", F.expr(f"_before + sum(_step_rows) {upto}"))
                .where(f"size({_wanted_ranks(probabilities, '_step_end - _step_rows', '_step_end')}) > 0")
                .selectExpr(*group, "_cell", "_step", "_step_end - _step_rows as _step_before")
            )
            in_steps = dense.join(steps, [*group, "_cell", "_step"])
            found = found.unionByName(ranked(in_steps, [*group, "_cell", "_step"], "_step_before"))
        found = found.unionByName(ranked(counted, [*group, "_cell"], "_before"))

    # At most two ranks per probability remain for each group and field.
    results = found.groupBy(*group, *carried).agg(F.expr("map_from_entries(collect_list(struct(_rank, _v))) as _at"))
    if keep_empty:
        empty = picked.where("_rows = 0").select(*group, *carried)
        results = results.unionByName(empty.withColumn("_at", F.lit(None).cast("map<bigint, double>")))
    return results.selectExpr(
        *group,
        "_rows as count",
        "_min as min",
        "_max as max",
        "_total / nullif(_rows, 0) as mean",
        f"if(_rows = 0, null, {_quantiles(probabilities)}) as quantiles",
    )
