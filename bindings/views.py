"""Domain views over the supplied tables.

The tables hold no nulls and no dirty cells, so the views put some in by fixed rules: every row
of ``lineitem`` is a sale, and no row is left out. The column expressions use only SQL that
Spark and DuckDB read alike, so that both sides of the check start from the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# column -> (expression, tables it needs besides lineitem)
SALES = {
    "ListingKey": ("concat(cast(l_orderkey as string), '-', cast(l_linenumber as string))", ""),
    "PropertyType": (
        "case when l_orderkey % 83 = 0 then null when l_returnflag = 'A' then 'Land' else 'Residential' end",
        "",
    ),
    "MlsStatus": ("case when l_linestatus = 'F' then 'Closed' else 'Active' end", ""),
    "CountyOrParish": ("case when l_orderkey % 97 = 0 then null else n_name end", "orders customer nation"),
    "OriginalListPrice": ("case when l_orderkey % 89 = 0 then cast(0 as double) else l_extendedprice end", ""),
    "ListPrice": ("case when l_orderkey % 23 = 0 then l_extendedprice * cast(1.25 as double) else l_extendedprice end", ""),
    "ClosePrice": (
        "case when l_orderkey % 53 = 0 then null else l_extendedprice * (1 - l_discount + l_tax)"
        " * case when l_orderkey % 101 = 0 then cast(20 as double) else cast(1 as double) end end",
        "",
    ),
    "LivingArea": (
        "case when l_partkey % 41 = 0 then null when l_partkey % 43 = 0 then cast(0 as double)"
        " when l_partkey % 37 = 0 then p_size * cast(5000 as double) else p_size * cast(100 as double) end",
        "part",
    ),
    "LotSizeAcres": ("case when l_suppkey % 9 = 0 then null else l_quantity / cast(100 as double) end", ""),
    "BedroomsTotal": ("case when l_partkey % 103 = 0 then -1 else l_linenumber end", ""),
    "BathroomsTotalInteger": ("case when l_partkey % 107 = 0 then -2 else l_linenumber % 3 end", ""),
    "YearBuilt": ("case when l_partkey % 29 = 0 then null else 1950 + p_size end", "part"),
    "ListingContractDate": ("cast(o_orderdate as date)", "orders"),
    "PurchaseContractDate": ("cast(o_orderdate as date) + cast(l_linenumber * 10 as int)", "orders"),
    "CloseDate": ("case when l_orderkey % 61 = 0 then null else cast(l_shipdate as date) end", ""),
    "DaysOnMarket": (
        "case when l_orderkey % 79 = 0 then null when l_orderkey % 71 = 0 then cast(-5 as double)"
        " when l_orderkey % 73 = 0 then cast(400 as double)"
        " else cast((l_orderkey * 7 + l_linenumber * 13) % 90 as double) end",
        "",
    ),
    "PostalCode": (
        "case when o_custkey % 13 = 0 then null when o_custkey % 11 = 0 then 'bad'"
        " else concat(cast(89000 + (o_custkey * 7) % 9000 as string), '-0001') end",
        "orders",
    ),
    "Latitude": (
        "case when l_orderkey % 47 = 0 then null when l_orderkey % 59 = 0 then cast(0 as double)"
        " else 30 + (l_partkey % 140) / cast(10 as double) end",
        "",
    ),
    "Longitude": (
        "case when l_orderkey % 47 = 0 then null when l_orderkey % 59 = 0 then cast(0 as double)"
        " when l_orderkey % 67 = 0 then cast(118 as double)"
        " else -126 + (l_orderkey % 130) / cast(10 as double) end",
        "",
    ),
    "StateOrProvince": (
        "case when o_custkey % 5 = 0 then null when o_custkey % 7 = 0 then ' '"
        " when o_custkey % 3 = 0 then 'AZ' else 'CA' end",
        "orders",
    ),
}

JOINS = {
    "orders": "o_orderkey = l_orderkey",
    "customer": "c_custkey = o_custkey",
    "nation": "n_nationkey = c_nationkey",
    "part": "p_partkey = l_partkey",
}

# Cells of the raw text export that differ from the typed view: texts that only parse in part.
DIRTY_NUMBER = "case when l_orderkey % 17 = 0 then 'N/A' when l_orderkey % 19 = 0 then '12d' else cast({0} as string) end"
DIRTY_DAY = "case when l_orderkey % 31 = 0 then '2024-13-01' when l_orderkey % 37 = 0 then '2024' else cast({0} as string) end"

# Text columns of the raw export beyond the sales columns: some mostly empty, some always dropped.
EXTRA_TEXT = {
    "ListAgentEmail": "cast('agent' as string)",
    "BuilderName": "case when l_orderkey % 20 = 0 then 'builder' end",
    "SubdivisionName": "case when l_orderkey % 10 < 2 then 'tract' end",
    "WaterfrontYN": "cast(null as string)",
    "latfilled": "cast(null as string)",
    "lonfilled": "cast(null as string)",
    "BuyerAgencyCompensationType": "cast('pct' as string)",
    "BuyerAgencyCompensation": "cast('2.5' as string)",
    "OriginatingSystemSubName": "cast('sub' as string)",
    "BusinessType": "cast(null as string)",
    "MiddleOrJuniorSchoolDistrict": "cast(null as string)",
    "TaxYear": "cast(null as string)",
    "FireplacesTotal": "cast(null as string)",
    "TaxAnnualAmount": "cast(null as string)",
    "AboveGradeFinishedArea": "cast(null as string)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str, needs: set[str]) -> DataFrame:
    """Sales beside the tables they need. Customers and nations are joined to the orders first, so that sales are shuffled by order and part alone."""

    def beside(df: DataFrame, name: str, other: DataFrame | None = None) -> DataFrame:
        return df.join(table(spark, sf_dir, name) if other is None else other, F.expr(JOINS[name])) if name in needs else df

    df = beside(table(spark, sf_dir, "lineitem"), "part")
    if "orders" not in needs:
        return df
    return beside(df, "orders", beside(beside(table(spark, sf_dir, "orders"), "customer"), "nation"))


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The given sales columns (all of them by default); only tables they need are joined."""
    wanted = columns or tuple(SALES)
    needs = {t for c in wanted for t in SALES[c][1].split()}
    return _joined(spark, sf_dir, needs).select(*[F.expr(SALES[c][0]).alias(c) for c in wanted])


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales columns as export text, with dirty cells and extra columns."""
    needs = {t for _, tables in SALES.values() for t in tables.split()}
    return _joined(spark, sf_dir, needs).select(
        *[F.expr(raw_cell(c)).alias(c) for c in SALES],
        *[F.expr(e).alias(c) for c, e in EXTRA_TEXT.items()],
        F.expr("cast(l_shipdate as string)").alias("ContractStatusChangeDate"),
    )


def raw_cell(column: str) -> str:
    expression = SALES[column][0]
    if column == "ListPrice":
        return DIRTY_NUMBER.format(f"({expression})")
    if column == "PurchaseContractDate":
        return DIRTY_DAY.format(f"({expression})")
    return f"cast({expression} as string)"


def quick_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw export with clean purchase dates, as strict date parsing demands."""
    clean = sales(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in SALES])
    return clean.select(
        "*",
        *[F.lit(None).cast("string").alias(c) for c in EXTRA_TEXT],
        F.concat("CloseDate", F.lit(" 10:00:00")).alias("ContractStatusChangeDate"),
    )


def weekly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekly text series with '.' for every week that starts in March, so that some months are empty."""
    weekly = (
        table(spark, sf_dir, "orders")
        .groupBy(F.expr("cast(date_trunc('week', o_orderdate) as date)").alias("week"))
        .agg(F.max("o_totalprice").alias("value"))
    )
    return weekly.selectExpr(
        "cast(week as string) as observation_date",
        "case when month(week) = 3 then '.' else cast(value as string) end as observation",
    )


# The same views as SQL text for DuckDB.
def sales_sql(*columns: str) -> str:
    wanted = columns or tuple(SALES)
    needs = {t for c in wanted for t in SALES[c][1].split()}
    joins = " ".join(f"join {name} on {condition}" for name, condition in JOINS.items() if name in needs)
    return f"select {', '.join(f'{SALES[c][0]} as {c}' for c in wanted)} from lineitem {joins}"


WEEKLY_SQL = (
    "select cast(date_trunc('week', o_orderdate) as date) as date, max(o_totalprice) as mortgage_rate_30yr "
    "from orders group by 1 having month(cast(date_trunc('week', o_orderdate) as date)) <> 3"
)
