"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabkit.functions import (
    clip, days_between, month_key, null_if, num, prefer, quotient, round_even, to_day, to_moment, zip5,
)
from tabkit.operators import clean as C
from tabkit.operators import enrich as E
from tabkit.operators import features as X
from tabkit.operators import flags as Q
from tabkit.operators import outliers as O
from tabkit.operators import profile as P
from tabkit.operators import segment as G
from tabkit.plans import pipeline as L
from tabkit.plans.config import LISTED, SOLD, PipelineConfig
from tabkit.sources import monthly as M
from tabkit.sources import pages as J
from tabkit.sources import sinks as K
from tabkit.sources.rates import typed_series
from tabkit.session import scratch_path
from tabkit.streaming.incremental import ingest_incremental
from tabkit.streaming.kept_values import KeptValues

from .views import quick_export, raw_export, sales, table, weekly_series

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

OUTLIER_FIELDS = SOLD.outlier_fields
OUTLIER_FLAGS = SOLD.outlier_flags
FEATURES = [
    "price_ratio", "price_per_sqft", "close_to_original_list_ratio",
    "listing_to_contract_days", "contract_to_close_days",
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "price_ratio": X.guarded_ratio("ClosePrice", "OriginalListPrice", 1000, 4, (0.5, 1.5)),
            "price_per_sqft": X.guarded_ratio("ClosePrice", "LivingArea", 0, 2),
        }
    )


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    return typed_series(weekly_series(spark, sf))


def _text_days(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


_fresh = scratch_path


# Segments and order

@query
def segment_summary(spark, sf):
    df = _ratios(sales(spark, sf, "CountyOrParish", "ClosePrice", "OriginalListPrice", "LivingArea", "DaysOnMarket",
                       "PurchaseContractDate", "ListingContractDate"))
    df = df.withColumn("listing_to_contract_days", days_between("PurchaseContractDate", "ListingContractDate"))
    medians = {
        "median_close_price": "ClosePrice",
        "median_price_per_sqft": "price_per_sqft",
        "median_price_ratio": "price_ratio",
        "median_dom": "DaysOnMarket",
        "median_list_to_contract": "listing_to_contract_days",
    }
    out = G.segment_summary(df, "CountyOrParish", medians, "ClosePrice", "sale_count")
    out = out.select(
        "CountyOrParish", "sale_count", *[round_even(m, 4).alias(m) for m in medians]
    )
    return G.order_by_desc(out, "median_close_price", "CountyOrParish")


@query
def group_center_top10(spark, sf):
    df = sales(spark, sf, "CountyOrParish", "ClosePrice")
    centers = G.group_center(df, "CountyOrParish", "ClosePrice", "median_close_price", "sale_count")
    top = G.top_k(centers, "median_close_price", "CountyOrParish", 10)
    return top.withColumn("median_close_price", round_even("median_close_price", 4))


@query
def group_total(spark, sf):
    return G.group_total(sales(spark, sf, "CountyOrParish").dropna().distinct())


@query
def sample_rows(spark, sf):
    df = _ratios(sales(spark, sf, "ListingKey", "ClosePrice", "OriginalListPrice", "LivingArea"))
    return G.sample_rows(
        C.drop_columns(df, ["absent"]).dropna(subset=["price_per_sqft"]),
        ["ListingKey", "ClosePrice", "price_ratio", "price_per_sqft"],
        ["ListingKey"],
    )


# Profiles

@query
def describe_schema(spark, sf):
    df = sales(spark, sf, "ListingKey", "ClosePrice", "CloseDate", "BedroomsTotal")
    return P.describe_schema(P.select_existing(df, ["ListingKey", "ClosePrice", "Absent", "CloseDate", "BedroomsTotal"]))


@query
def file_row_counts(spark, sf):
    names = ("orders", "lineitem", "customer")
    frames = [table(spark, sf, n).select(F.col("_metadata.file_name").alias("source_file")) for n in names]
    return P.file_row_counts(M.union_monthly(frames))


@query
def frequency_table(spark, sf):
    return P.frequency_table(sales(spark, sf, "PropertyType"), "PropertyType")


@query
def frequency_table_events(spark, sf):
    return P.frequency_table(table(spark, sf, "events"), "event_type")


@query
def other_categories(spark, sf):
    df = sales(spark, sf, "PropertyType")
    return P.frequency_table(C.complement_filter(df, "PropertyType", "Residential"), "PropertyType")


@query
def filter_category(spark, sf):
    df = C.filter_category(sales(spark, sf, "PropertyType", "MlsStatus"), "PropertyType", "Residential")
    return P.frequency_table(df, "MlsStatus")


@query
def distinct_values(spark, sf):
    return P.distinct_values(sales(spark, sf, "PropertyType"), "PropertyType")


@query
def missing_report(spark, sf):
    return P.missing_report(sales(spark, sf))


@query
def critical_missing(spark, sf):
    return L.quick_missing(sales(spark, sf), LISTED).select("column", "missing_count")


@query
def drop_high_missing(spark, sf):
    raw = C.normalise_tokens(raw_export(spark, sf))
    kept = C.drop_high_missing(raw, 90.0, keep=SOLD.essential)
    return P.describe_schema(kept).select("column", "rows")


@query
def drop_columns(spark, sf):
    return C.drop_columns(sales(spark, sf, "ListingKey", "Latitude", "ClosePrice"), ["Latitude", "Absent"])


@query
def text_columns(spark, sf):
    df = sales(spark, sf)
    return P.missing_report(df, P.text_columns(df)).select("column", "missing_count")


@query
def numeric_profile(spark, sf):
    return P.numeric_profile(sales(spark, sf), ["Absent", *SOLD.profile_fields])


@query
def numeric_profile_documents(spark, sf):
    return P.numeric_profile(table(spark, sf, "documents"), ["n_chars"])


@query
def category_share(spark, sf):
    return P.category_share(sales(spark, sf, "PropertyType"), "PropertyType", "Residential")


@query
def center_and_skew(spark, sf):
    return P.center_and_skew(sales(spark, sf, "ClosePrice"), "ClosePrice")


@query
def value_distribution(spark, sf):
    return P.value_distribution(sales(spark, sf, "DaysOnMarket"), "DaysOnMarket")


@query
def above_at_below(spark, sf):
    return P.above_at_below(sales(spark, sf, "ClosePrice", "ListPrice"), "ClosePrice", "ListPrice")


@query
def price_change_buckets(spark, sf):
    df = sales(spark, sf, "OriginalListPrice", "ClosePrice").withColumnRenamed("ClosePrice", "ListPrice")
    return P.price_change_buckets(df, "OriginalListPrice", "ListPrice")


@query
def date_order_counts(spark, sf):
    days = ["CloseDate", "ListingContractDate", "PurchaseContractDate"]
    return P.date_order_counts(_text_days(sales(spark, sf, *days), *days), *days)


@query
def listing_date_issues(spark, sf):
    df = sales(spark, sf, "ListingContractDate", "CloseDate")
    return P.listing_date_issues(df, "ListingContractDate", "CloseDate", as_of="1998-01-01")


@query
def dataset_span(spark, sf):
    span = P.dataset_span(sales(spark, sf, "ListingKey", "CloseDate"), "CloseDate")
    return _text_days(span, "first_date", "last_date")


@query
def key_stats(spark, sf):
    return P.key_stats(sales(spark, sf, "ClosePrice", "LivingArea", "DaysOnMarket"), SOLD.outlier_fields)


# Typing and row rules

@query
def coerce_numbers(spark, sf):
    raw = raw_export(spark, sf)
    return raw.select("ListingKey", num("ListPrice").alias("list_price"), num("LivingArea").alias("area"))


@query
def coerce_dates(spark, sf):
    raw = raw_export(spark, sf)
    day = to_day("PurchaseContractDate")
    return raw.select(
        "ListingKey",
        day.cast("string").alias("purchase"),
        F.date_format(to_moment("ContractStatusChangeDate"), "yyyy-MM-dd HH:mm:ss").alias("changed"),
    )


@query
def coercion_report(spark, sf):
    raw = C.normalise_tokens(raw_export(spark, sf))
    typing = C.Typing(dates=["PurchaseContractDate", "CloseDate"], numbers=["ListPrice", "ClosePrice", "Absent"])
    return C.coercion_report(raw, typing)


@query
def null_sentinel(spark, sf):
    typed = weekly_series(spark, sf).select("observation_date", null_if("observation", ".").alias("value"))
    return P.missing_report(typed)


@query
def row_ledger(spark, sf):
    return C.row_ledger(sales(spark, sf), L.row_rules(SOLD))


@query
def valid_rows(spark, sf):
    kept = C.apply_rules(sales(spark, sf), L.row_rules(LISTED))
    return kept.select("ListingKey", "ListPrice", "LivingArea", "DaysOnMarket")


@query
def valid_pair(spark, sf):
    return P.valid_pair(sales(spark, sf, "ListingKey", "ClosePrice", "OriginalListPrice"), "ClosePrice", "OriginalListPrice").select(
        "ListingKey"
    )


@query
def union_by_name(spark, sf):
    prices = sales(spark, sf, "ListingKey", "ClosePrice")
    areas = sales(spark, sf, "LivingArea", "ListingKey")
    return P.missing_report(M.union_monthly([prices, areas]))


# Series

@query
def resample_monthly(spark, sf):
    return E.resample_monthly(_rates(spark, sf))


@query
def series_range(spark, sf):
    return _text_days(E.series_range(_rates(spark, sf)), "first_date", "last_date")


@query
def last_months(spark, sf):
    return G.last_k(E.resample_monthly(_rates(spark, sf)), "year_month")


@query
def enrich_monthly_rate(spark, sf):
    df = sales(spark, sf, "ListingKey", "CloseDate")
    rich = E.enrich_monthly_rate(df, E.resample_monthly(_rates(spark, sf)), "CloseDate")
    return rich.select("ListingKey", "year_month", "mortgage_rate_30yr")


@query
def rate_null_check(spark, sf):
    df = sales(spark, sf, "ListingContractDate")
    rich = E.enrich_monthly_rate(df, E.resample_monthly(_rates(spark, sf)), "ListingContractDate")
    return P.null_check(rich, E.RATE)


@query
def enrich_without_source(spark, sf):
    df = E.enrich_or_null(sales(spark, sf, "CloseDate"), None, "CloseDate")
    return df.groupBy("year_month").agg(F.count("*").alias("rows"), F.count(E.RATE).alias("rates"))


# Flags

@query
def timeline_flags(spark, sf):
    df = Q.timeline_flags(sales(spark, sf, "ListingKey", "ListingContractDate", "PurchaseContractDate", "CloseDate"))
    return df.select("ListingKey", "listing_after_close_flag", "purchase_after_close_flag", "negative_timeline_flag")


@query
def coord_flags(spark, sf):
    return Q.coord_flags(sales(spark, sf, "ListingKey", "Latitude", "Longitude")).drop("Latitude", "Longitude")


@query
def postal_flag(spark, sf):
    df = Q.code_range_flag(sales(spark, sf, "ListingKey", "PostalCode"))
    return df.select("ListingKey", zip5("PostalCode").alias("zip5"), "non_ca_postal_flag")


@query
def flag_summary(spark, sf):
    return P.flag_summary(Q.quality_flags(sales(spark, sf)), L.QUALITY_FLAGS)


@query
def in_region(spark, sf):
    return Q.in_region(sales(spark, sf, "ListingKey", "StateOrProvince", "Latitude", "Longitude")).select("ListingKey")


@query
def postal_filter(spark, sf):
    return Q.drop_out_of_band_postal(sales(spark, sf, "ListingKey", "PostalCode"))


# Features

@query
def price_features_sold(spark, sf):
    df = L.add_features(sales(spark, sf, "ListingKey", "ClosePrice", "OriginalListPrice", "LivingArea"), SOLD)
    return df.select("ListingKey", *FEATURES[:3])


@query
def price_features_listed(spark, sf):
    df = sales(spark, sf, "ListingKey", "ClosePrice", "ListPrice", "OriginalListPrice", "LivingArea")
    return L.add_features(df, LISTED).select("ListingKey", *FEATURES[:3])


@query
def plain_ratios(spark, sf):
    df = sales(spark, sf, "ListingKey", "ClosePrice", "LivingArea", "OriginalListPrice")
    return df.select(
        "ListingKey",
        quotient("ClosePrice", "LivingArea").alias("per_area"),
        quotient("ClosePrice", "OriginalListPrice").alias("ratio"),
    )


@query
def clipped_ratio(spark, sf):
    df = sales(spark, sf, "ListingKey", "ClosePrice", "ListPrice")
    paid = prefer("ClosePrice", F.col("ClosePrice") > 0, "ListPrice")
    return df.select("ListingKey", clip(quotient(paid, "ListPrice"), 0.9, 1.1).alias("ratio"))


@query
def durations(spark, sf):
    days = ["ListingContractDate", "PurchaseContractDate", "CloseDate"]
    return L.add_features(sales(spark, sf, "ListingKey", *days), SOLD).select("ListingKey", *FEATURES[3:])


@query
def time_parts(spark, sf):
    df = X.time_parts(sales(spark, sf, "ListingKey", "CloseDate"), "CloseDate", "close_year", "close_month", "close_yrmo")
    return df.drop("CloseDate")


@query
def sales_by_month(spark, sf):
    df = sales(spark, sf, "CloseDate").select(month_key("CloseDate").alias("month"))
    return P.frequency_table(df, "month")


# Outliers

@query
def iqr_fences(spark, sf):
    fences = O.iqr_fences(sales(spark, sf, *OUTLIER_FIELDS), OUTLIER_FIELDS)
    return fences.select("field", *[round_even(c, 4).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")])


@query
def outlier_flags(spark, sf):
    df = O.outlier_flags(sales(spark, sf, "ListingKey", *OUTLIER_FIELDS), OUTLIER_FIELDS)
    return df.select("ListingKey", *OUTLIER_FLAGS)


@query
def outlier_summary(spark, sf):
    return P.flag_summary(O.outlier_flags(sales(spark, sf, *OUTLIER_FIELDS), OUTLIER_FIELDS), OUTLIER_FLAGS, 1)


@query
def drop_flagged(spark, sf):
    df = O.outlier_flags(sales(spark, sf, "ListingKey", *OUTLIER_FIELDS), OUTLIER_FIELDS)
    return Q.drop_flagged(df, OUTLIER_FLAGS).select("ListingKey")


@query
def median_shift(spark, sf):
    df = O.outlier_flags(sales(spark, sf, *OUTLIER_FIELDS), OUTLIER_FIELDS)
    return O.median_shift(df, OUTLIER_FIELDS, OUTLIER_FLAGS)


@query
def iqr_filter_sequential(spark, sf):
    df = O.iqr_filter_sequential(sales(spark, sf, "ListingKey", *OUTLIER_FIELDS), OUTLIER_FIELDS)
    return df.select("ListingKey")


# Whole pipelines

def _run(spark: SparkSession, sf: str, cfg: PipelineConfig) -> L.PipelineRun:
    raw = C.normalise_tokens(raw_export(spark, sf))
    # The combined text and the cleaned table are written once; later stages read only the columns they need.
    return L.PipelineRun(
        raw, cfg, _rates(spark, sf), _fresh(spark, cfg.name), as_of="1998-01-01", stages=("combined", "cleaned")
    )


@query
def sold_final(spark, sf):
    parts = ["close_year", "close_month", "close_yrmo"]
    return _run(spark, sf, SOLD).final.select(
        "ListingKey", "ClosePrice", "ListPrice", *FEATURES, *parts, "mortgage_rate_30yr", *L.QUALITY_FLAGS
    )


@query
def sold_final_ledger(spark, sf):
    return _run(spark, sf, SOLD).report("final_ledger")


@query
def sold_key_stats(spark, sf):
    return _run(spark, sf, SOLD).report("key_stats")


@query
def sold_cleaned_flags(spark, sf):
    return _run(spark, sf, SOLD).report("quality_flags")


@query
def listed_final(spark, sf):
    parts = ["listing_year", "listing_month", "listing_yrmo"]
    return _run(spark, sf, LISTED).final.select(
        "ListingKey", "ClosePrice", "ListPrice", *FEATURES, *parts, "mortgage_rate_30yr", *L.QUALITY_FLAGS
    )


@query
def listed_segments(spark, sf):
    raw = C.normalise_tokens(raw_export(spark, sf))
    rows = L.add_features(L.clean(L.combine(raw, LISTED), LISTED), LISTED)
    report = L.segment_report(rows, LISTED)
    medians = [c for c in report.columns if c.startswith("median")]
    return report.withColumns({m: round_even(m, 4) for m in medians})


@query
def quick_sold(spark, sf):
    df = L.run_quick(quick_export(spark, sf), SOLD)
    return df.select("ListingKey", "PriceRatio", "PricePerSqFt", "CloseYear", "CloseMonth", "YrMo")


@query
def quick_listed(spark, sf):
    df = L.run_quick(quick_export(spark, sf), LISTED)
    return df.select("ListingKey", "PriceRatio", "ListPricePerSqFt", "ListYear", "ListMonth", "YrMo")


# Files that Spark derives from the tables

@query
def monthly_csv(spark, sf):
    """Writes one export per closing month and reads them all back by header."""
    folder = _fresh(spark, "monthly")
    named = sales(spark, sf, "ListingKey", "ClosePrice", "CountyOrParish", "CloseDate").withColumn(
        "export", F.concat(F.lit("Sales"), F.coalesce(F.date_format("CloseDate", "yyyyMM"), F.lit("190001")), F.lit(".csv"))
    )
    K.write_stage(named, folder, "csv", partition_by=["export"])
    files = M.discover_monthly(spark, folder, "export=Sales")
    read = M.read_monthly_csv(spark, files, source="source_file")
    return read.groupBy(F.regexp_extract("source_file", "([0-9]{6})", 1).alias("month")).agg(
        F.count("*").alias("rows"),
        F.count("CountyOrParish").alias("counties"),
        F.min(num("ClosePrice")).alias("lowest"),
        F.max(num("ClosePrice")).alias("highest"),
    )


def _landed_pages(spark: SparkSession, sf: str, columns: list[str]) -> str:
    """Lands all sales as JSON pages, one line for each order."""
    folder = _fresh(spark, "pages")
    rows = sales(spark, sf, *columns)
    cells = F.struct(*[F.col(c).cast("string").alias(c) for c in columns])
    order = F.substring_index("ListingKey", "-", 1).alias("order")
    pages = rows.select(order, cells.alias("record")).groupBy("order").agg(F.collect_list("record").alias("value"))
    pages.drop("order").write.json(folder)
    return folder


@query
def closed_month_pages(spark, sf):
    """One closed month of the landed pages."""
    columns = ["ListingKey", "MlsStatus", "CloseDate", "ClosePrice", "PropertyType"]
    records = J.read_pages(spark, _landed_pages(spark, sf, columns), columns, one_per_file=False)
    return J.closed_month(records, "1995-03").select("ListingKey", num("ClosePrice").alias("ClosePrice"), "PropertyType")


@query
def listing_month_pages(spark, sf):
    """One listing month of the landed pages; ``City`` is a key that no record has."""
    columns = ["ListingKey", "ListingContractDate", "ListPrice"]
    records = J.read_pages(spark, _landed_pages(spark, sf, columns), [*columns, "City"], one_per_file=False)
    return J.listing_month(records, "1995-03").select("ListingKey", num("ListPrice").alias("ListPrice"), "City")


def _exported_month(spark: SparkSession, sf: str, cfg: PipelineConfig) -> DataFrame:
    """One month from landed pages to an export and back."""
    columns = ["ListingKey", "MlsStatus", "CloseDate", "ListingContractDate", cfg.price, "PropertyType"]
    folder = _fresh(spark, "exports")
    L.pages_to_monthly(spark, _landed_pages(spark, sf, columns), "1995-03", cfg, folder, "Export", one_per_file=False)
    back = M.read_monthly_csv(spark, M.discover_monthly(spark, folder, "Export"))
    assert back.columns == cfg.export_columns
    return back.select("ListingKey", num(cfg.price).alias("price"), "PropertyType", "City")


@query
def pages_to_monthly_sold(spark, sf):
    return _exported_month(spark, sf, SOLD)


@query
def pages_to_monthly_listed(spark, sf):
    return _exported_month(spark, sf, LISTED)


@query
def monthly_header_copies(spark, sf):
    """An export that repeats header cells: the second copy is dropped, a third one stays under its own name."""
    folder = f"{_fresh(spark, 'copies')}/L199501.csv"
    lines = sales(spark, sf, "ListingKey", "PropertyType").select(
        F.concat_ws(",", "ListingKey", F.coalesce("PropertyType", F.lit("")), F.lit("second"), F.lit("third")).alias(
            "ListingKey,PropertyType,ListingKey,ListingKey"
        )
    )
    lines.write.option("header", True).option("sep", "\u0001").csv(folder)
    read = M.read_monthly_csv(spark, [folder])
    return read.select("ListingKey", "PropertyType", F.col("`ListingKey.2`").alias("third"), F.lit(len(read.columns)).alias("columns"))


@query
def single_file_schema(spark, sf):
    """One export looked at by itself."""
    df = sales(spark, sf, "ListingKey", "ClosePrice", "CloseDate").where("year(CloseDate) = 1995")
    path = K.write_month(df.select(*[F.col(c).cast("string") for c in df.columns]), _fresh(spark, "single"), "Sold", "1995-00", df.columns)
    return P.describe_schema(M.read_monthly_csv(spark, [path], source="source_file"))


def _raw_csv(df: DataFrame, record: Column, header: str, path: str, encoding: str = "UTF-8") -> str:
    """Files of records and header just as they are given, whatever the cells."""
    raw = df.select(record.alias(header)).write.option("header", True).option("sep", "\u0001").option("quote", "")
    raw.option("encoding", encoding).csv(path)
    return path


@query
def ragged_csv(spark, sf):
    """Records with too many and too few cells land in the table of rejects; those that fit are read."""
    folder = _fresh(spark, "ragged")
    df = sales(spark, sf, "ListingKey", "CountyOrParish", "DaysOnMarket").withColumn("n", F.col("DaysOnMarket").cast("long"))
    county = F.concat(F.lit('"'), F.coalesce("CountyOrParish", F.lit("")), F.lit(', area"'))
    record = F.concat_ws(",", "ListingKey", county)
    record = F.when(F.col("n") % 7 == 0, F.concat(record, F.lit(",more"))).when(F.col("n") % 11 == 0, F.col("ListingKey")).otherwise(record)
    path = _raw_csv(df, record, "ListingKey,Area", f"{folder}/S199501.csv")
    read = M.read_monthly_csv(spark, [path], rejects=f"{folder}/rejects")
    kept = read.select(F.lit(2).cast("long").alias("cells"), F.col("ListingKey").alias("record"))
    return kept.unionByName(spark.read.parquet(f"{folder}/rejects").select("cells", "record"))


@query
def short_records_filled(spark, sf):
    """Absent cells at the end of a record read as null where that is wanted."""
    folder = _fresh(spark, "short")
    df = sales(spark, sf, "ListingKey", "StateOrProvince", "PropertyType")
    record = F.when(F.col("PropertyType").isNull(), F.col("ListingKey")).otherwise(F.concat_ws(",", "ListingKey", F.coalesce("StateOrProvince", F.lit("")), "PropertyType"))
    path = _raw_csv(df, record, "ListingKey,State,Type", f"{folder}/S199501.csv")
    return M.read_monthly_csv(spark, [path], short="fill")


@query
def latin1_header(spark, sf):
    """Accented header cells and values in the export's own encoding unite with a month in which they stand in another order."""
    folder = _fresh(spark, "latin")
    df = sales(spark, sf, "ListingKey", "CountyOrParish")
    late = F.col("ListingKey").rlike("[0-4]$")
    county = F.concat(F.lit("Évry "), F.coalesce("CountyOrParish", F.lit("?")))
    paths = [
        _raw_csv(df.where(late), F.concat_ws(",", "ListingKey", county), "Clé,Préfecture", f"{folder}/S199501.csv", "ISO-8859-1"),
        _raw_csv(df.where(~late), F.concat_ws(",", county, "ListingKey"), "Préfecture,Clé", f"{folder}/S199502.csv", "ISO-8859-1"),
    ]
    return M.read_monthly_csv(spark, paths).select(F.col("Clé").alias("key"), F.col("Préfecture").alias("county"))


@query
def multiline_header(spark, sf):
    """A header cell with a line break is one column."""
    df = sales(spark, sf, "ListingKey", "StateOrProvince")
    df = df.select(F.col("ListingKey").alias("Listing\nKey"), F.col("StateOrProvince").alias("State"), F.lit("x").alias("Third"))
    path = f"{_fresh(spark, 'lines')}/S199501.csv"
    K.write_stage(df, path, "csv")
    read = M.read_monthly_csv(spark, [path])
    return read.select(F.col("`Listing\nKey`").alias("key"), "State", F.lit(len(read.columns)).alias("columns"))


@query
def export_types(spark, sf):
    """The type of each column of an export, from all its values."""
    columns = ["ListingKey", "ClosePrice", "DaysOnMarket", "YearBuilt", "CountyOrParish", "CloseDate"]
    df = sales(spark, sf, *columns).withColumns({"DaysOnMarket": F.col("DaysOnMarket").cast("long"), "YearBuilt": F.col("YearBuilt").cast("long")})
    path = K.write_month(df.select(*[F.col(c).cast("string") for c in columns]), _fresh(spark, "types"), "Sold", "1995-00", columns)
    typed = P.with_inferred_types(M.read_monthly_csv(spark, [path]))
    schema = P.describe_schema(typed)
    return schema.withColumn("is_text", F.col("column").isin(P.text_columns(typed)))


def _linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of one order each, a chain in the order of the keys: own address, next address, records."""
    rows = sales(spark, sf, "ListingKey")
    order = F.substring_index("ListingKey", "-", 1).cast("long").alias("order")
    pages = rows.select(order, F.struct("ListingKey").alias("record")).groupBy("order").agg(F.collect_list("record").alias("value"))
    # Orders are numbered in blocks of eight of which some are absent, so the next address is looked up.
    following = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order")).distinct()
    following = following.select("order", F.lead("order").over(Window.partitionBy(F.expr("order div 1000")).orderBy("order")).alias("next"))
    return pages.join(following, "order").select(
        "order", "value", F.concat(F.lit("page/"), "order").alias(J.OWN_LINK), F.concat(F.lit("page/"), "next").alias(J.NEXT_LINK)
    )


@query
def page_chains(spark, sf):
    """Chains of a thousand order numbers: every record of complete ones, and the links that dangle once each seventh page is gone."""
    folder = _fresh(spark, "chains")
    pages = _linked_pages(spark, sf)
    pages.drop("order").write.json(f"{folder}/whole")
    pages.where("order % 7 <> 0").drop("order").write.json(f"{folder}/torn")
    records = J.read_pages(spark, f"{folder}/whole", ["ListingKey"], one_per_file=False)
    dangling = J.dangling_links(spark, f"{folder}/torn", one_per_file=False)
    return records.select(F.lit("record").alias("kind"), F.col("ListingKey").alias("what")).union(dangling.select(F.lit("dangling"), "link"))


@query
def corrected_month(spark, sf):
    """Exports ingested, one month of them corrected, another added, and ingested again."""
    folder = _fresh(spark, "corrected")
    df = sales(spark, sf, "ListingKey", "ListPrice", "CloseDate").where("year(CloseDate) = 1995")

    def land(month: str, factor: int) -> None:
        rows = df.where(F.date_format("CloseDate", "yyyy-MM") == month).select("ListingKey", (F.col("ListPrice") * factor).cast("string").alias("ListPrice"))
        K.write_month(rows, f"{folder}/in", "Sold", month, rows.columns)

    land("1995-01", 1)
    land("1995-02", 1)
    first = ingest_incremental(spark, f"{folder}/in", "Sold", f"{folder}/out", f"{folder}/seen")
    land("1995-02", 2)
    land("1995-03", 1)
    second = ingest_incremental(spark, f"{folder}/in", "Sold", f"{folder}/out", f"{folder}/seen")
    third = ingest_incremental(spark, f"{folder}/in", "Sold", f"{folder}/out", f"{folder}/seen")
    kept = spark.read.schema("ListingKey string, ListPrice string, source_file string, month string").parquet(f"{folder}/out")
    runs = F.lit(f"{','.join(first)} {','.join(second)} {','.join(third)}")
    return kept.select("ListingKey", num("ListPrice").alias("ListPrice"), "month", runs.alias("runs"))


def _kept(spark: SparkSession, sf: str, fields: list[str], keys: list[str]) -> tuple[KeptValues, Column]:
    """Counts of all sales kept by month of closing, one month of them wrong at first; and the months that each refresh read."""
    folder = _fresh(spark, "kept")
    df = sales(spark, sf, *keys, *fields, "CloseDate").withColumn("month", F.date_format("CloseDate", "yyyyMM"))
    wrong = F.col("month") == "199502"
    landed = df.select(*keys, "month", *[F.when(wrong, F.lit(1)).otherwise(F.col(f)).alias(f) for f in fields])
    # Rows are dealt by month first: else every task leaves a file in every month, and their number grows with that of the tasks.
    K.write_stage(landed.where("month is not null and month < '199807'"), f"{folder}/sold", partition_by=["month"])
    kept = KeptValues(spark, f"{folder}/kept", fields, keys)
    first = kept.refresh(f"{folder}/sold")
    df.where(wrong).drop("month", "CloseDate").write.mode("overwrite").parquet(f"{folder}/sold/month=199502")
    # What has no month of closing comes with the last months.
    late = df.where("month is null or month >= '199807'").withColumn("month", F.coalesce("month", F.lit("none"))).drop("CloseDate")
    late.hint("rebalance", F.col("month")).write.mode("append").partitionBy("month").parquet(f"{folder}/sold")
    second = kept.refresh(f"{folder}/sold")
    again = set(first) & set(second)
    return kept, F.lit(f"{','.join(sorted(again))} {len(kept.refresh(f'{folder}/sold'))}")


@query
def kept_fences(spark, sf):
    """Fences over stored counts, after a month was corrected and others were added."""
    kept, again = _kept(spark, sf, OUTLIER_FIELDS, [])
    fences = O.fences_of(kept.distribution(OUTLIER_FIELDS, O.FENCE_PROBABILITIES))
    return fences.select("field", *[round_even(c, 4).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")], again.alias("again"))


@query
def kept_profile(spark, sf):
    """The numeric profile over stored counts."""
    kept, again = _kept(spark, sf, SOLD.profile_fields, [])
    return P.profile_of(kept.distribution(SOLD.profile_fields, P.PROFILE_PROBABILITIES)).withColumn("again", again)


@query
def kept_segments(spark, sf):
    """Medians per county over stored counts."""
    kept, again = _kept(spark, sf, ["ClosePrice"], ["CountyOrParish"])
    stats = kept.distribution(["ClosePrice"], [0.5], keep_empty=True)
    found = G.segments_of(stats, "CountyOrParish", {"median": "ClosePrice"}, "ClosePrice", "sale_count")
    return found.select("CountyOrParish", round_even("median", 4).alias("median_close_price"), "sale_count", again.alias("again"))


def _odd_cells(df: DataFrame) -> DataFrame:
    """Cells with blanks at both ends, accents, quotes, separators and line breaks."""
    state = F.concat(F.lit(" "), F.coalesce("StateOrProvince", F.lit("none")), F.lit(" "))
    name = F.concat(F.lit("Jos\u00e9 \"the\u00a0"), F.col("ListingKey"), F.lit('",\n\ttwo  lines '))
    return df.select("ListingKey", state.alias("state"), name.alias("name"), F.lit("\\n").alias("slash"))


@query
def odd_cells_csv(spark, sf):
    """Cells that a careless writer would change, through a stage and back."""
    folder = f"{_fresh(spark, 'odd')}/Odd199501.csv"
    K.write_stage(_odd_cells(sales(spark, sf, "ListingKey", "StateOrProvince")), folder, "csv")
    return M.read_monthly_csv(spark, [folder])


@query
def odd_cells_month(spark, sf):
    """The same through a monthly export in another encoding."""
    odd = _odd_cells(sales(spark, sf, "ListingKey", "StateOrProvince"))
    path = K.write_month(odd, _fresh(spark, "odd"), "Odd", "1995-01", odd.columns, encoding="UTF-8")
    return M.read_monthly_csv(spark, [path], encoding="UTF-8")


def _read_report(spark: SparkSession, report: DataFrame, index: str | None = None) -> DataFrame:
    """A report written to its file and read back with the types of the report."""
    path = _fresh(spark, "report")
    K.write_report(report, path, index)
    return spark.read.schema(report.schema).option("header", True).option("enforceSchema", True).csv(path)


@query
def missing_report_file(spark, sf):
    return _read_report(spark, P.missing_report(sales(spark, sf)), index="column")


@query
def numeric_report_file(spark, sf):
    return _read_report(spark, P.numeric_profile(sales(spark, sf), SOLD.profile_fields))


@query
def segment_report_file(spark, sf):
    return _read_report(spark, segment_summary(spark, sf))


@query
def quick_sold_file(spark, sf):
    """The export of the quick variant, read back."""
    folder = f"{_fresh(spark, 'quick')}/Quick199501.csv"
    L.run_quick(quick_export(spark, sf), SOLD, out=folder)
    back = M.read_monthly_csv(spark, [folder])
    numbers = [num(c).alias(c) for c in ("PriceRatio", "PricePerSqFt")]
    return back.select("ListingKey", *numbers, *[F.col(c).cast("int") for c in ("CloseYear", "CloseMonth")], "YrMo")


@query
def sold_stages(spark, sf):
    """Rows per written stage; the last two are laid out by month and read by it."""
    raw, out = C.normalise_tokens(raw_export(spark, sf)), _fresh(spark, "stages")
    run = L.run_pipeline(raw, SOLD, _rates(spark, sf), out)
    frames = [(n, spark.read.schema(getattr(run, n).schema).parquet(f"{out}/sold_{n}")) for n in L.STAGES]
    month = [(f"{n}_month", df.where(F.col("close_yrmo") == "1995-03")) for n, df in frames[-2:]]
    counts = [df.agg(F.lit(n).alias("stage"), F.count("*").alias("rows")) for n, df in [*frames, *month]]
    return M.union_monthly(counts)


@query
def listing_in_future(spark, sf):
    """Listings after today, the dates moved by thirty years."""
    df = sales(spark, sf, "ListingContractDate", "CloseDate").withColumn("ListingContractDate", F.date_add("ListingContractDate", 11000))
    return P.listing_date_issues(df, "ListingContractDate", "CloseDate")
