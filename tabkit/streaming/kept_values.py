"""Percentiles kept up to date while months are added, corrected and taken away.

Of every month of a table in folders ``month=...`` two small tables are stored: its values, counted per group and field
and sorted by cell, and the cells' counts and sums (see ``operators.distribution``). Cells of months add up, so ranks, means
and extremes over all months come from the stored cells. The values are read for the cells that hold a wanted rank only. Rows
of the table itself are read once, when their month is new or another one than before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.distribution import (
    BROADCAST_ROWS, DENSE_ROWS, MEASURES, add_cells, cells_of_counts, count_values, distribution_of_cells,
)
from ..operators.profile import padded
from ..session import cut_lineage
from ..sources.monthly import _glob_name, path_end
from .incremental import _exists

_SEEN = "file string, length long, changed timestamp, month string"
# Up to as many (field, cell) pairs go into the plan as a filter that the files' statistics can answer.
FILTER_CELLS = 200


class KeptValues:
    """Stored counts of the numeric ``fields`` of a table, per group of ``keys`` and month.

    ``path`` holds the counts and what they were made from; one path serves one table and one choice of fields and keys. ``typed`` makes
    numbers of the fields where the table has text. Keys are held as text. Fields and keys that a month lacks
    are null there; a row with a null key counts nowhere. Null and NaN are no values.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        fields: Sequence[str],
        keys: Sequence[str] = (),
        typed: Callable[[DataFrame], DataFrame] = lambda df: df,
    ):
        self.spark, self.path, self.fields, self.keys, self.typed = spark, path.rstrip("/"), list(fields), list(keys), typed
        self.group = [*[f"_k{i}" for i in range(len(self.keys))], "_field"]
        held = "".join(f"`{g}` string, " for g in self.group)
        self._schemas = {
            "values": f"{held}_cell int, _v double, _n bigint, month string",
            "cells": f"{held}_cell int, _cell_rows bigint, _low double, _high double, _high_sum bigint, _low_sum bigint, month string",
            "seen": _SEEN,
        }

    def _stored(self, name: str) -> DataFrame:
        folder = f"{self.path}/{name}"
        schema = self._schemas[name]
        if not _exists(self.spark, _glob_name(folder)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(_glob_name(folder))

    def _replace(self, rows: DataFrame, name: str, order: Sequence[str] = ()) -> None:
        """The months of ``rows`` in place of those stored; other months are left alone."""
        rows = rows.hint("rebalance", F.col("month"))
        if order:
            rows = rows.sortWithinPartitions("month", *order)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{self.path}/{name}")

    def _empty(self, month: str, name: str) -> None:
        rows = self._stored(name).where(F.lit(False)).drop("month")
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/month={month}")

    def refresh(self, table: str) -> list[str]:
        """Bring the counts up to date with the Parquet ``table``; the months whose rows were read or that are gone.

        A month counts again, as a whole, if a file of it is new, has another length or time, or is gone. Its note is written last, so a run that
        failed is made good by the next. Read no percentiles while a run goes on. One row per changed month comes to the driver.
        """
        folder = table.rstrip("/")
        names = f"{_glob_name(folder)}/month=*/*.parquet"
        listing = self.spark.createDataFrame([], _SEEN)
        if _exists(self.spark, names):
            listing = self.spark.read.format("binaryFile").load(names).select(
                F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "length", F.col("modificationTime").alias("changed"),
                F.regexp_extract("path", "/month=([^/]*)/[^/]*$", 1).alias("month"),
            )
        # Held: what is noted is what was there before rows were read.
        landed = cut_lineage(listing)
        seen = self._stored("seen")
        same = ["file", "length", "changed", "month"]
        new = landed.join(seen, same, "left_anti").select("month")
        lost = seen.join(landed, same, "left_anti").select("month")
        changed = [r["month"] for r in new.union(lost).distinct().orderBy("month").collect()]
        present = {r["month"] for r in landed.where(F.col("month").isin(changed)).select("month").distinct().collect()}
        there = [m for m in changed if m in present]
        if there:
            rows = self.spark.read.option("mergeSchema", True).option("basePath", folder).parquet(*[_glob_name(f"{folder}/month={m}") for m in there])
            month = F.regexp_extract(path_end(), "^month=([^/]*)/[^/]*$", 1)
            wanted = [*self.keys, *self.fields]
            own = padded(self.typed(rows.select("*", month.alias("_month"))), wanted)
            counted = count_values(own.select("_month", *wanted), ["_month", *self.keys], self.fields)
            named = [F.col("_k0").alias("month"), *[F.col(f"_k{i + 1}").cast("string").alias(f"_k{i}") for i in range(len(self.keys))]]
            values = counted.select(*named, "_field", "_cell", "_v", "_n")
            # A row that counts nothing for every month, so that a month left without values replaces what was stored of it.
            marks = self.spark.createDataFrame([(m, 0) for m in there], "month string, _n bigint")
            self._replace(values.unionByName(marks, allowMissingColumns=True), "values", ["_field", "_cell"])
            values = self._stored("values").where(F.col("month").isin(there))
            self._replace(cells_of_counts(values, ["month", *self.group]), "cells")
        for gone in sorted(set(changed) - present):
            for name in ("values", "cells", "seen"):
                self._empty(gone, name)
        if there:
            self._replace(landed.where(F.col("month").isin(there)), "seen")
        return changed

    def _values_in(self, cells: DataFrame) -> DataFrame:
        """The stored values of (at least) the given cells; of a few cells, only the pages of the files that hold them are read."""
        stored = self._stored("values").where("_v is not null")
        wanted = cells.select("_field", "_cell").distinct().limit(FILTER_CELLS + 1).collect()
        if len(wanted) > FILTER_CELLS:
            return stored
        held = F.lit(False)
        for field in sorted({r["_field"] for r in wanted}):
            held = held | ((F.col("_field") == field) & F.col("_cell").isin([r["_cell"] for r in wanted if r["_field"] == field]))
        return stored.where(held)

    def distribution(
        self,
        fields: Sequence[str],
        probabilities: Sequence[float],
        keep_empty: bool = False,
        dense_rows: int = DENSE_ROWS,
        broadcast_rows: int = BROADCAST_ROWS,
    ) -> DataFrame:
        """What ``operators.distribution`` gives for all rows of all months, keys as text."""
        unknown = [f for f in fields if f not in self.fields]
        if unknown:
            raise ValueError(f"not among the fields kept: {unknown}")
        cells = add_cells(self._stored("cells").where(F.col("_field").isin(list(fields))), self.group)
        found = distribution_of_cells(cells, self._values_in, self.group, [float(p) for p in probabilities], dense_rows, broadcast_rows, keep_empty)
        return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(self.keys)], F.col("_field").alias("field"), *MEASURES)
