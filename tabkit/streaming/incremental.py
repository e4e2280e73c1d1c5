"""Pick up newly landed or corrected monthly exports, and new pages, without reading the old ones again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.monthly import _glob_name, read_monthly_csv
from ..sources.pages import page_schema, records

_SEEN = "month string, file string, part string, length long, changed timestamp"


def _landed(spark: SparkSession, landing: str, prefix: str) -> DataFrame:
    """(month, file, part, length, changed) of every export file; a part is a file of an export that is a folder. Only the listing is read."""
    names = f"{_glob_name(landing.rstrip('/'))}/{_glob_name(prefix)}{'[0-9]' * 6}.csv{{,/part-*}}"
    listing = spark.read.format("binaryFile").load(names)
    pattern = r"^(.*([0-9]{6})\.csv)(/[^/]*)?$"
    return listing.select(
        F.regexp_extract("path", pattern, 2).alias("month"), F.regexp_extract("path", pattern, 1).alias("file"), F.regexp_extract("path", pattern, 3).alias("part"),
        "length", F.col("modificationTime").alias("changed"),
    ).distinct()


def changed_months(spark: SparkSession, landing: str, prefix: str, checkpoint: str) -> DataFrame:
    """The files of all months of which a file is new, has another length or time than when it was read, or is gone while others remain."""
    landed = _landed(spark, landing, prefix)
    seen = spark.read.schema(_SEEN).option("recursiveFileLookup", "true").parquet(checkpoint) if _exists(spark, checkpoint) else None
    if seen is None:
        return landed
    same = ["month", "file", "part", "length", "changed"]
    new = landed.join(seen, same, "left_anti").select("month")
    gone = seen.join(landed, same, "left_anti").select("month")
    return landed.join(new.union(gone).distinct(), "month", "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").head(1)
    except Exception as error:  # the class differs between classic and Connect sessions
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return False
    return True


def ingest_incremental(
    spark: SparkSession, landing: str, prefix: str, out: str, checkpoint: str, source: str = "source_file", **options: str
) -> list[str]:
    """Bring the Parquet table ``out``, one folder ``month=YYYYMM`` per month, up to date with the exports ``<prefix>YYYYMM.csv``; the months read.

    An export is a file or a folder of part files. A month whose files are new, or differ in length or time from those read before, is read
    again as a whole and replaces its folder; all others are left alone. What was read is noted per month below ``checkpoint`` after its folder is written, so that a run
    that failed is made good by the next. A month whose export is gone keeps its rows. Months go one after the other, each with the columns of its own
    headers: read the table with ``mergeSchema``. ``options`` go to ``read_monthly_csv``.
    """
    # One row per file of a changed month, as its paths are what the reader is given.
    files = changed_months(spark, landing, prefix, checkpoint).collect()
    months = sorted({f["month"] for f in files})
    for month in months:
        own = [f for f in files if f["month"] == month]
        rows = read_monthly_csv(spark, sorted({f["file"] for f in own}), source=source, **options)
        rows.write.mode("overwrite").parquet(f"{out}/month={month}")
        spark.createDataFrame(own, _SEEN).coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/{month}")
    return months


def ingest_pages_incremental(
    spark: SparkSession, landing: str, columns: Sequence[str], out: str, checkpoint: str
) -> None:
    """Append records of new JSON pages to a Parquet table."""
    rows = (
        spark.readStream.schema(page_schema(columns))
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(landing)
        .select(records())
    )
    query = (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
