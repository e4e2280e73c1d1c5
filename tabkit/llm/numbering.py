"""Gapless numbers and running totals within keys, without one task holding a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted(rows_per_cell: int, rows: int) -> int:
    """How many cells each key is cut into so that a key with all rows has ``rows_per_cell`` in each."""
    return max(1, -(-rows // rows_per_cell))


def running_before(
    df: DataFrame, keys: list[str], spread_by: Column, cells: int, order: list[Column], weight: Column, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over rows of the same keys that come earlier.

    Rows come in the order of their cell (``pmod(hash(spread_by), cells)``), then of ``order``. Each
    cell is one window; the totals of the cells before it come from a table of one row per key and
    cell. ``order`` must be total for a repeatable result. ``df`` is read twice.
    """
    cell, amount, base = f"__{out}_cell", f"__{out}_amount", f"__{out}_base"
    rows = df.withColumn(cell, F.pmod(F.xxhash64(spread_by), F.lit(cells)).cast("int")).withColumn(amount, weight.cast("long"))
    totals = rows.groupBy(*keys, cell).agg(F.sum(amount).alias(base))
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn(base, F.coalesce(F.sum(base).over(earlier), F.lit(0)))
    within = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn(out, F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return numbered.join(bases, [*keys, cell]).withColumn(out, F.col(out) + F.col(base)).drop(cell, amount, base)
