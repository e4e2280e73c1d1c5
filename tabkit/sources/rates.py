"""A two-column dated series, such as a weekly interest rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import null_if, num, to_day
from ..operators.enrich import RATE


def typed_series(raw: DataFrame, value: str = RATE, sentinel: str = ".") -> DataFrame:
    """Two text columns, renamed by position to date and value; rows without a value dropped."""
    named = raw.toDF("date", value)
    return named.select(to_day("date").alias("date"), num(null_if(value, sentinel)).alias(value)).dropna(
        subset=[value]
    )


def read_rate_series(spark: SparkSession, path: str, value: str = RATE) -> DataFrame:
    raw = spark.read.schema("c0 string, c1 string").option("header", True).csv(path)
    return typed_series(raw, value)


def rate_series_or_none(spark: SparkSession, path: str | None, value: str = RATE) -> DataFrame | None:
    """The series, or nothing when there is no source; enrichment then fills nulls."""
    if not path:
        return None
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        listing.load(path).select("path").head(1)
    except Exception as error:  # the class differs between classic and Connect sessions
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return read_rate_series(spark, path, value)
