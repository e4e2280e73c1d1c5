"""Landed JSON pages: one object per file with the records in its ``value`` array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import to_moment


#: Fields of a page: the address of the page after it, and its own, as the job that lands pages may note it.
NEXT_LINK, OWN_LINK = "@odata.nextLink", "@odata.id"


def page_schema(columns: Sequence[str]) -> T.StructType:
    record = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return T.StructType([T.StructField("value", T.ArrayType(record))])


def records() -> Column:
    """The records of a page; a page without a ``value`` array, such as an error message, fails the job."""
    bad = F.raise_error(F.lit("a page without a value array"))
    return F.inline(F.when(F.col("value").isNull(), bad).otherwise(F.col("value")))


def dangling_links(
    spark: SparkSession, path: str, one_per_file: bool = True, next_link: str = NEXT_LINK, own_link: str = OWN_LINK
) -> DataFrame:
    """(link): addresses of next pages that did not land; empty for complete chains.

    A link is found when a landed page has it as its own address. Where no page states its address, links can only be counted: a chain has a
    page without a next one, so with as many different links as pages one is missing, and all links are returned.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (next_link, own_link)])
    pages = spark.read.schema(schema).option("multiLine", one_per_file).option("mode", "FAILFAST").json(path).toDF("next", "own")
    links = pages.where("next is not null").select(F.col("next").alias("link")).distinct()
    seen = pages.agg(F.count("*").alias("pages"), F.count("own").alias("addresses"), F.count_distinct("next").alias("links")).first()
    if seen["addresses"]:
        return links.join(pages.select(F.col("own").alias("link")).distinct(), "link", "left_anti")
    return links.where(F.lit(seen["links"] >= seen["pages"]))


def read_pages(
    spark: SparkSession, path: str, columns: Sequence[str], one_per_file: bool = True, complete: bool = True
) -> DataFrame:
    """One row per record, text columns; an absent key is null. A corrupt page fails the job, and so does an error page.

    A page is a file of its own, or a line of a larger file (which Spark can split). With ``complete``, the links of all pages are read first, and a next page
    that did not land is an error that names it.
    """
    if complete:
        missing = [r["link"] for r in dangling_links(spark, path, one_per_file).limit(3).collect()]
        if missing:
            raise ValueError(f"pages of {path} go on at pages that did not land: {', '.join(missing)}")
    pages = (
        spark.read.schema(page_schema(columns))
        .option("multiLine", one_per_file)
        .option("mode", "FAILFAST")
        .json(path)
    )
    return pages.select(records())


def in_month(date: str, month: str) -> Column:
    """The half-open month ``yyyy-MM`` that contains the date."""
    first = F.to_date(F.lit(f"{month}-01"))
    moment = to_moment(date)
    return (moment >= first) & (moment < F.add_months(first, 1))


def closed_month(df: DataFrame, month: str, status: str = "Closed") -> DataFrame:
    return df.where((F.col("MlsStatus") == status) & in_month("CloseDate", month))


def listing_month(df: DataFrame, month: str) -> DataFrame:
    return df.where(in_month("ListingContractDate", month))
