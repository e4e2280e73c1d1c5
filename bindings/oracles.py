"""The expected answers as SQL for DuckDB, written against the sales views of ``views.py``."""

from __future__ import annotations

from .views import SALES, EXTRA_TEXT, WEEKLY_SQL, sales_sql

S = "with s as ({}) "


def _s(*columns: str) -> str:
    return S.format(sales_sql(*columns))


def r(expression: str, digits: int = 2) -> str:
    return f"round_even(({expression}) * {10**digits}::double, 0) / {10**digits}::double"


def pct(part: str, whole: str, digits: int) -> str:
    return r(f"100.0::double * ({part}) / nullif(({whole})::double, 0)", digits)


def _missing(columns, source="s", extra="") -> str:
    parts = " union all ".join(
        f"select '{c}' as \"column\", count(*) filter (where {c} is null) as missing_count,"
        f" {pct(f'count(*) filter (where {c} is null)', 'count(*)', 2)} as missing_pct from {source}"
        for c in columns
    )
    return parts


def _profile(fields, source="s") -> str:
    q = lambda f, p: r(f"quantile_cont({f}::double, {p})")
    return " union all ".join(
        f"select '{f}' as field, count({f}) as count, {r(f'min({f})::double')} as min, {q(f, 0.25)} as p25,"
        f" {q(f, 0.5)} as median, {r(f'avg({f}::double)')} as mean, {q(f, 0.75)} as p75, {q(f, 0.9)} as p90,"
        f" {q(f, 0.99)} as p99, {r(f'max({f})::double')} as max from {source}"
        for f in fields
    )


def _key_stats(fields, source) -> str:
    return " union all ".join(
        f"select '{f}' as field, {r(f'median({f}::double)')} as median, {r(f'avg({f}::double)')} as mean,"
        f" {r(f'min({f})::double')} as min, {r(f'max({f})::double')} as max from {source}"
        for f in fields
    )


def _summary(flags, source, digits=2) -> str:
    return " union all ".join(
        f"select '{f}' as flag, count(*) filter (where {f}) as rows,"
        f" {pct(f'count(*) filter (where {f})', 'count(*)', digits)} as pct from {source}"
        for f in flags
    )


def _fences(fields, source, name="f") -> str:
    cells = ", ".join(
        f"quantile_cont({f}, 0.25) - 1.5 * (quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)) as {f}_lo,"
        f"quantile_cont({f}, 0.75) + 1.5 * (quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)) as {f}_hi"
        for f in fields
    )
    return f"{name} as (select {cells} from {source})"


def _outlier(field: str) -> str:
    return f"coalesce({field} < {field}_lo or {field} > {field}_hi, false)"


MONTHLY = f"""w as ({WEEKLY_SQL}),
m as (select date_trunc('month', date) as month, sum(cast(mortgage_rate_30yr as decimal(28,8))) as total, count(*) as n
      from w group by 1),
cal as (select unnest(generate_series((select min(month) from m)::timestamp, (select max(month) from m)::timestamp, interval 1 month)) as month),
monthly as (select strftime(cal.month, '%Y-%m') as year_month,
            {r('m.total::double / m.n', 4)} as mortgage_rate_30yr from cal left join m on m.month = cal.month)"""

LATER = "coalesce({} > {}, false)"
LISTING_AFTER = LATER.format("ListingContractDate", "CloseDate")
PURCHASE_AFTER = LATER.format("PurchaseContractDate", "CloseDate")
ZIP = "try_cast(nullif(regexp_extract(PostalCode, '^([0-9]{5})', 1), '') as integer)"
BAD_ZIP = f"coalesce({ZIP} not between 90001 and 96162, false)"
FLAG_SQL = {
    "listing_after_close_flag": LISTING_AFTER,
    "purchase_after_close_flag": PURCHASE_AFTER,
    "negative_timeline_flag": f"({LISTING_AFTER}) or ({PURCHASE_AFTER})",
    "missing_coords_flag": "Latitude is null or Longitude is null",
    "zero_coords_flag": "coalesce(Latitude = 0 and Longitude = 0, false)",
    "positive_longitude_flag": "coalesce(Longitude > 0, false)",
    "out_of_state_flag": "Latitude is not null and Longitude is not null"
    " and not (Latitude between 32.5 and 42.1 and Longitude between -124.5 and -114.1)",
    "non_ca_postal_flag": BAD_ZIP,
}
FLAGS = ", ".join(f"({e}) as {n}" for n, e in FLAG_SQL.items())
REGION = (
    "coalesce(StateOrProvince = 'CA' or ((StateOrProvince is null or trim(StateOrProvince) = '')"
    " and Latitude between 32 and 42 and Longitude between -124 and -114), false)"
)


def ratio(a, b, guard, digits):
    return f"case when {b} > {guard} then {r(f'({a}) / {b}', digits)} end"


RATIO = ratio("ClosePrice", "OriginalListPrice", 1000, 4)
SOLD_RATIO = f"case when ({RATIO}) is not null then greatest(0.5::double, least(1.5::double, {RATIO})) end"
SOLD_FEATURES = f"""{SOLD_RATIO} as price_ratio, {ratio('ClosePrice', 'LivingArea', 0, 2)} as price_per_sqft,
 {SOLD_RATIO} as close_to_original_list_ratio"""
PAID = "case when ClosePrice > 0 then ClosePrice else ListPrice end"
LISTED_FEATURES = f"""{ratio('ListPrice', 'OriginalListPrice', 0, 4)} as price_ratio,
 {ratio('ListPrice', 'LivingArea', 0, 2)} as price_per_sqft,
 {ratio(PAID, 'OriginalListPrice', 0, 4)} as close_to_original_list_ratio"""
DURATIONS = """datediff('day', ListingContractDate, PurchaseContractDate) as listing_to_contract_days,
 datediff('day', PurchaseContractDate, CloseDate) as contract_to_close_days"""


def parts(date, year, month, yrmo):
    return f"year({date}) as {year}, month({date}) as {month}, strftime({date}, '%Y-%m') as {yrmo}"


OUTLIER_FIELDS = ["ClosePrice", "LivingArea", "DaysOnMarket"]
ROW_RULES = [
    "coalesce({price} > 0, false)",
    "LivingArea is null or LivingArea > 0",
    "DaysOnMarket is null or DaysOnMarket >= 0",
    "BedroomsTotal is null or BedroomsTotal >= 0",
    "BathroomsTotalInteger is null or BathroomsTotalInteger >= 0",
]
RULE_NAMES = ["{price} <= 0 or missing", "LivingArea <= 0", "DaysOnMarket < 0", "BedroomsTotal < 0", "BathroomsTotalInteger < 0"]


def _ledger(steps, source):
    """Counts rows that pass all steps up to each one."""
    rows, kept = [], "true"
    for i, (name, condition) in enumerate(steps):
        after = f"{kept} and ({condition})"
        rows.append(
            f"select {i + 1} as step, '{name}' as name, count(*) filter (where {kept}) as rows_before,"
            f" count(*) filter (where {kept}) - count(*) filter (where {after}) as removed,"
            f" count(*) filter (where {after}) as rows_after from {source}"
        )
        kept = after
    return " union all ".join(rows)


# The raw export as the pipelines see it after typing: dirty cells are null.
KEY = "cast(split_part(ListingKey, '-', 1) as bigint)"


def _typed() -> str:
    cells = {
        "ListPrice": f"case when {KEY} % 17 = 0 or {KEY} % 19 = 0 then null else ListPrice end",
        "PurchaseContractDate": f"case when {KEY} % 31 = 0 or {KEY} % 37 = 0 then null else PurchaseContractDate end",
    }
    return ", ".join(f"{cells[c]} as {c}" if c in cells else c for c in SALES)


def _pipeline(price: str, features: str, time: str) -> str:
    """Common table expressions from the sales view to ``flagged`` and ``final``."""
    fields = [price, "LivingArea", "DaysOnMarket"]
    rules = " and ".join(f"({c.format(price=price)})" for c in ROW_RULES)
    event = "CloseDate" if price == "ClosePrice" else "ListingContractDate"
    flags = ", ".join(f"{_outlier(f)} as {f}_outlier_flag" for f in fields)
    outlier = " or ".join(f"{f}_outlier_flag" for f in fields)
    return f"""with s as ({sales_sql()}), {MONTHLY},
t as (select {_typed()} from s where PropertyType = 'Residential'),
cleaned as (select *, {FLAGS} from t where {rules}),
featured as (select cleaned.*, {features}, {DURATIONS}, {time}, monthly.mortgage_rate_30yr
             from cleaned left join monthly on monthly.year_month = strftime({event}, '%Y-%m')),
{_fences(fields, 'cleaned')},
flagged as (select featured.*, {flags} from featured, f),
final as (select * from flagged where not ({outlier}) and {REGION} and not {BAD_ZIP}) """


SOLD_TIME = parts("CloseDate", "close_year", "close_month", "close_yrmo")
LISTED_TIME = parts("ListingContractDate", "listing_year", "listing_month", "listing_yrmo")
FINAL_COLUMNS = """ListingKey, ClosePrice, ListPrice, price_ratio, price_per_sqft, close_to_original_list_ratio,
listing_to_contract_days, contract_to_close_days, """ + ", ".join(FLAG_SQL) + ", mortgage_rate_30yr"
SOLD_PIPELINE = _pipeline("ClosePrice", SOLD_FEATURES, SOLD_TIME)
LISTED_PIPELINE = _pipeline("ListPrice", LISTED_FEATURES, LISTED_TIME)


def _sequential(first: str) -> str:
    """Common table expressions t0..t3, each trimmed by the fences of the one before."""
    ctes, source = [], "t0"
    for i, f in enumerate([first, "LivingArea", "DaysOnMarket"]):
        ctes.append(_fences([f], source, f"f{i}"))
        ctes.append(f"t{i + 1} as (select {source}.* from {source}, f{i} where {f} between {f}_lo and {f}_hi)")
        source = f"t{i + 1}"
    return ", ".join(ctes)


def _quick(price, per_area, time):
    return f"""with s as ({sales_sql()}),
t0 as (select * from s where PropertyType = 'Residential' and {price} is not null and LivingArea is not null),
{_sequential(price)}
select ListingKey, ClosePrice / nullif(ListPrice, 0) as PriceRatio, {price} / nullif(LivingArea, 0) as {per_area}, {time} from t3"""


def _schema(columns, source, with_position=False):
    return " union all ".join(
        f"select '{c}' as \"column\", count(*) as rows from {source}" for c in columns
    )


TEXT_COLUMNS = ["ListingKey", "PropertyType", "MlsStatus", "CountyOrParish", "PostalCode", "StateOrProvince"]
RAW_COLUMNS = [*SALES, *EXTRA_TEXT, "ContractStatusChangeDate"]
MOSTLY_MISSING = [
    "BuilderName", "WaterfrontYN", "latfilled", "lonfilled", "BusinessType", "MiddleOrJuniorSchoolDistrict",
    "TaxYear", "FireplacesTotal", "TaxAnnualAmount", "AboveGradeFinishedArea",
]
ALWAYS_DROPPED = ["ListAgentEmail", "OriginatingSystemSubName", "BusinessType", "MiddleOrJuniorSchoolDistrict", "TaxYear", "TaxAnnualAmount"]
LISTED_CRITICAL = [
    "ListPrice", "OriginalListPrice", "LivingArea", "DaysOnMarket", "PropertyType", "ListingContractDate",
    "PostalCode", "BedroomsTotal", "BathroomsTotalInteger", "MlsStatus",
]
DAYS = "cast(count(*) filter (where {}) as bigint)"
CHANGE = r("(OriginalListPrice - ClosePrice) / OriginalListPrice * 100", 2)


def _shares(names, digits=1):
    return ", ".join(f'"{n}", {pct(f'"{n}"', 'valid', digits)} as {n}_pct' for n in names)


ODD_CELLS = """select ListingKey, concat(' ', coalesce(StateOrProvince, 'none'), ' ') as state,
concat('Jos', chr(233), ' "the', chr(160), ListingKey, '",', chr(10), chr(9), 'two  lines ') as name, '\\n' as slash from s"""
PROFILE = [
    "ListPrice", "OriginalListPrice", "LivingArea", "LotSizeAcres",
    "BedroomsTotal", "BathroomsTotalInteger", "DaysOnMarket", "YearBuilt",
]

ORACLES: dict[str, str] = {
    "segment_summary": _s("CountyOrParish", "ClosePrice", "OriginalListPrice", "LivingArea", "DaysOnMarket",
                          "PurchaseContractDate", "ListingContractDate")
    + f""", t as (select *, {SOLD_FEATURES}, datediff('day', ListingContractDate, PurchaseContractDate) as d from s)
    select CountyOrParish, count(ClosePrice) as sale_count, {r('median(ClosePrice)', 4)} as median_close_price,
    {r('median(price_per_sqft)', 4)} as median_price_per_sqft, {r('median(price_ratio)', 4)} as median_price_ratio,
    {r('median(DaysOnMarket)', 4)} as median_dom, {r('median(d)', 4)} as median_list_to_contract
    from t where CountyOrParish is not null group by 1""",
    "group_center_top10": _s("CountyOrParish", "ClosePrice")
    + f"""select CountyOrParish, {r('median(ClosePrice)', 4)} as median_close_price, count(ClosePrice) as sale_count
    from s where CountyOrParish is not null group by 1 order by median(ClosePrice) desc nulls last, 1 limit 10""",
    "group_total": _s("CountyOrParish") + "select count(distinct CountyOrParish) as groups from s",
    "sample_rows": _s("ListingKey", "ClosePrice", "OriginalListPrice", "LivingArea")
    + f""", t as (select *, {SOLD_FEATURES} from s) select ListingKey, ClosePrice, price_ratio, price_per_sqft
    from t where price_per_sqft is not null order by ListingKey limit 5""",
    "describe_schema": " union all ".join(
        f"select {i} as position, '{c}' as \"column\", '{t}' as type, count(*) as rows, 4 as columns from lineitem"
        for i, (c, t) in enumerate(
            [("ListingKey", "string"), ("ClosePrice", "double"), ("CloseDate", "date"), ("BedroomsTotal", "int")], 1
        )
    ),
    "file_row_counts": " union all ".join(
        f"select '{n}.parquet' as source_file, count(*) as rows from {n}" for n in ("orders", "lineitem", "customer")
    ),
    "frequency_table": _s("PropertyType") + "select PropertyType, count(*) as count from s group by 1",
    "frequency_table_events": "select event_type, count(*) as count from events group by 1",
    "other_categories": _s("PropertyType")
    + "select PropertyType, count(*) as count from s where PropertyType is distinct from 'Residential' group by 1",
    "filter_category": _s("PropertyType", "MlsStatus")
    + "select MlsStatus, count(*) as count from s where PropertyType = 'Residential' group by 1",
    "distinct_values": _s("PropertyType") + "select distinct PropertyType from s",
    "missing_report": _s() + _missing(SALES),
    "critical_missing": _s() + f"select \"column\", missing_count from ({_missing(LISTED_CRITICAL)})",
    "drop_high_missing": _schema([c for c in RAW_COLUMNS if c not in MOSTLY_MISSING], "lineitem"),
    "drop_columns": _s("ListingKey", "ClosePrice") + "select ListingKey, ClosePrice from s",
    "text_columns": _s() + f"select \"column\", missing_count from ({_missing(TEXT_COLUMNS)})",
    "numeric_profile": _s() + _profile(
        ["ClosePrice", "ListPrice", "OriginalListPrice", "LivingArea", "LotSizeAcres", "BedroomsTotal",
         "BathroomsTotalInteger", "DaysOnMarket", "YearBuilt"]
    ),
    "numeric_profile_documents": _profile(["n_chars"], "documents"),
    "category_share": _s("PropertyType")
    + f""", c as (select count(*) as total, count(*) filter (where PropertyType = 'Residential') as in_category from s)
    select total, in_category, {pct('in_category', 'total', 1)} as in_category_pct, total - in_category as other,
    {pct('total - in_category', 'total', 1)} as other_pct from c""",
    "center_and_skew": _s("ClosePrice")
    + f"""select {r('median(ClosePrice)')} as median, {r('avg(ClosePrice)')} as mean,
    {r('avg(ClosePrice) - median(ClosePrice)')} as mean_minus_median from s""",
    "value_distribution": _s("DaysOnMarket")
    + f"select count, min, median, mean, p75, p90, p99, max from ({_profile(['DaysOnMarket'])})",
    "above_at_below": _s("ClosePrice", "ListPrice")
    + f""", c as (select count(*) as valid, count(*) filter (where ClosePrice / ListPrice > 1) as above,
    count(*) filter (where ClosePrice / ListPrice = 1) as "at", count(*) filter (where ClosePrice / ListPrice < 1) as below
    from s where ClosePrice is not null and ListPrice > 0) select valid, {_shares(['above', 'at', 'below'])} from c""",
    "price_change_buckets": _s("OriginalListPrice", "ClosePrice")
    + f""", v as (select {CHANGE} as change from s where ClosePrice is not null and OriginalListPrice > 0),
    c as (select count(*) as valid, count(*) filter (where change > 0) as reduced,
    count(*) filter (where change = 0) as unchanged, count(*) filter (where change < 0) as raised,
    avg(change) filter (where change > 0) as a from v)
    select valid, {_shares(['reduced', 'unchanged', 'raised'])}, {r('a', 1)} as mean_reduction_pct from c""",
    "date_order_counts": _s("CloseDate", "ListingContractDate", "PurchaseContractDate")
    + f""", c as (select count(*) filter (where CloseDate is not null and ListingContractDate is not null) as close_and_listing,
    count(*) filter (where CloseDate < ListingContractDate) as close_before_listing,
    count(*) filter (where CloseDate is not null and PurchaseContractDate is not null) as close_and_purchase,
    count(*) filter (where PurchaseContractDate > CloseDate) as purchase_after_close from s)
    select *, {pct('close_before_listing', 'close_and_listing', 2)} as close_before_listing_pct,
    {pct('purchase_after_close', 'close_and_purchase', 2)} as purchase_after_close_pct from c""",
    "listing_date_issues": _s("CloseDate", "ListingContractDate")
    + f""", c as (select count(*) filter (where CloseDate is not null and ListingContractDate is not null) as close_and_listing,
    count(*) filter (where CloseDate < ListingContractDate) as close_before_listing,
    count(*) filter (where ListingContractDate > date '1998-01-01') as listing_in_future from s)
    select *, {pct('close_before_listing', 'greatest(close_and_listing, 1)', 2)} as close_before_listing_pct from c""",
    "dataset_span": _s("ListingKey", "CloseDate")
    + """select count(*) as rows, 2 as columns, cast(min(CloseDate) as varchar) as first_date,
    cast(max(CloseDate) as varchar) as last_date from s""",
    "key_stats": _s(*OUTLIER_FIELDS) + _key_stats(OUTLIER_FIELDS, "s"),
    "coerce_numbers": _s("ListingKey", "ListPrice", "LivingArea")
    + f"select ListingKey, case when {KEY} % 17 <> 0 and {KEY} % 19 <> 0 then ListPrice end as list_price, LivingArea as area from s",
    "coerce_dates": """with t as (select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as ListingKey,
    case when l_orderkey % 31 = 0 then '2024-13-01' when l_orderkey % 37 = 0 then '2024'
    else cast(cast(o_orderdate as date) + cast(l_linenumber * 10 as int) as varchar) end as p, l_shipdate
    from lineitem join orders on o_orderkey = l_orderkey)
    select ListingKey, cast(cast(try_strptime(p, '%Y-%m-%d') as date) as varchar) as purchase,
    strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as changed from t""",
    "coercion_report": _s("ListingKey")
    + f"""select 'PurchaseContractDate' as "column", count(*) filter (where {KEY} % 31 = 0 or {KEY} % 37 = 0) as new_nulls from s
    union all select 'CloseDate', 0 union all select 'ListPrice', count(*) filter (where {KEY} % 17 <> 0 and {KEY} % 19 = 0) from s
    union all select 'ClosePrice', 0""",
    "null_sentinel": f"""with t as (select cast(date_trunc('week', o_orderdate) as date) as d, max(o_totalprice) as v from orders group by 1),
    u as (select d as observation_date, case when month(d) <> 3 then v end as value from t) """
    + _missing(["observation_date", "value"], "u"),
    "row_ledger": _s()
    + _ledger([(n.format(price="ClosePrice"), c.format(price="ClosePrice")) for n, c in zip(RULE_NAMES, ROW_RULES)], "s"),
    "valid_rows": _s("ListingKey", "ListPrice", "LivingArea", "DaysOnMarket", "BedroomsTotal", "BathroomsTotalInteger")
    + "select ListingKey, ListPrice, LivingArea, DaysOnMarket from s where "
    + " and ".join(f"({c.format(price='ListPrice')})" for c in ROW_RULES),
    "valid_pair": _s("ListingKey", "ClosePrice", "OriginalListPrice")
    + "select ListingKey from s where ClosePrice is not null and OriginalListPrice > 0",
    "union_by_name": _s("ListingKey", "ClosePrice", "LivingArea")
    + """, u as (select ListingKey, ClosePrice, null::double as LivingArea from s
    union all select ListingKey, null, LivingArea from s) """
    + _missing(["ListingKey", "ClosePrice", "LivingArea"], "u"),
    "resample_monthly": f"with {MONTHLY} select * from monthly",
    "series_range": f"""with w as ({WEEKLY_SQL}) select count(*) as observations, cast(min(date) as varchar) as first_date,
    cast(max(date) as varchar) as last_date, min(mortgage_rate_30yr) as lowest, max(mortgage_rate_30yr) as highest from w""",
    "last_months": f"with {MONTHLY} select * from monthly order by year_month desc limit 6",
    "enrich_monthly_rate": _s("ListingKey", "CloseDate")
    + f""", {MONTHLY} select ListingKey, strftime(CloseDate, '%Y-%m') as year_month, mortgage_rate_30yr
    from s left join monthly on monthly.year_month = strftime(CloseDate, '%Y-%m')""",
    "rate_null_check": _s("ListingContractDate")
    + f""", {MONTHLY} select count(*) as rows, count(*) filter (where mortgage_rate_30yr is null) as null_rows
    from s left join monthly on monthly.year_month = strftime(ListingContractDate, '%Y-%m')""",
    "enrich_without_source": _s("CloseDate")
    + "select strftime(CloseDate, '%Y-%m') as year_month, count(*) as rows, 0 as rates from s group by 1",
    "timeline_flags": _s("ListingKey", "ListingContractDate", "PurchaseContractDate", "CloseDate")
    + "select ListingKey, " + ", ".join(f"({FLAG_SQL[n]}) as {n}" for n in list(FLAG_SQL)[:3]) + " from s",
    "coord_flags": _s("ListingKey", "Latitude", "Longitude")
    + "select ListingKey, " + ", ".join(f"({FLAG_SQL[n]}) as {n}" for n in list(FLAG_SQL)[3:7]) + " from s",
    "postal_flag": _s("ListingKey", "PostalCode") + f"select ListingKey, {ZIP} as zip5, {BAD_ZIP} as non_ca_postal_flag from s",
    "flag_summary": _s() + f", t as (select *, {FLAGS} from s) " + _summary(FLAG_SQL, "t"),
    "in_region": _s("ListingKey", "StateOrProvince", "Latitude", "Longitude") + f"select ListingKey from s where {REGION}",
    "postal_filter": _s("ListingKey", "PostalCode") + f"select ListingKey, PostalCode from s where not {BAD_ZIP}",
    "price_features_sold": _s("ListingKey", "ClosePrice", "OriginalListPrice", "LivingArea")
    + f"select ListingKey, {SOLD_FEATURES} from s",
    "price_features_listed": _s("ListingKey", "ClosePrice", "ListPrice", "OriginalListPrice", "LivingArea")
    + f"select ListingKey, {LISTED_FEATURES} from s",
    "plain_ratios": _s("ListingKey", "ClosePrice", "LivingArea", "OriginalListPrice")
    + """select ListingKey, ClosePrice / nullif(LivingArea, 0) as per_area,
    ClosePrice / nullif(OriginalListPrice, 0) as ratio from s""",
    "clipped_ratio": _s("ListingKey", "ClosePrice", "ListPrice")
    + f"select ListingKey, greatest(0.9::double, least(1.1::double, ({PAID}) / ListPrice)) as ratio from s",
    "durations": _s("ListingKey", "ListingContractDate", "PurchaseContractDate", "CloseDate") + f"select ListingKey, {DURATIONS} from s",
    "time_parts": _s("ListingKey", "CloseDate") + f"select ListingKey, {SOLD_TIME} from s",
    "sales_by_month": _s("CloseDate") + "select strftime(CloseDate, '%Y-%m') as month, count(*) as count from s group by 1",
    "iqr_fences": _s(*OUTLIER_FIELDS)
    + " union all ".join(
        f"""select '{f}' as field, {r('q1', 4)} as q1, {r('q3', 4)} as q3, {r('q3 - q1', 4)} as iqr,
        {r('q1 - 1.5 * (q3 - q1)', 4)} as lower, {r('q3 + 1.5 * (q3 - q1)', 4)} as upper
        from (select quantile_cont({f}, 0.25) as q1, quantile_cont({f}, 0.75) as q3 from s)"""
        for f in OUTLIER_FIELDS
    ),
    "outlier_flags": _s("ListingKey", *OUTLIER_FIELDS)
    + f", {_fences(OUTLIER_FIELDS, 's')} select ListingKey, "
    + ", ".join(f"{_outlier(f)} as {f}_outlier_flag" for f in OUTLIER_FIELDS) + " from s, f",
    "outlier_summary": _s(*OUTLIER_FIELDS)
    + f", {_fences(OUTLIER_FIELDS, 's')}, t as (select "
    + ", ".join(f"{_outlier(f)} as {f}_outlier_flag" for f in OUTLIER_FIELDS) + " from s, f) "
    + _summary([f"{f}_outlier_flag" for f in OUTLIER_FIELDS], "t", 1),
    "drop_flagged": _s("ListingKey", *OUTLIER_FIELDS)
    + f", {_fences(OUTLIER_FIELDS, 's')} select ListingKey from s, f where not ("
    + " or ".join(_outlier(f) for f in OUTLIER_FIELDS) + ")",
    "median_shift": _s(*OUTLIER_FIELDS)
    + f", {_fences(OUTLIER_FIELDS, 's')}, t as (select s.*, ("
    + " or ".join(_outlier(f) for f in OUTLIER_FIELDS) + ") as out from s, f) "
    + " union all ".join(
        f"""select '{f}' as field, {r(f'median({f})')} as median_before,
        {r(f'median({f}) filter (where not out)')} as median_after,
        {r(f'median({f}) filter (where not out) - median({f})')} as shift from t"""
        for f in OUTLIER_FIELDS
    ),
    "iqr_filter_sequential": f"with t0 as ({sales_sql('ListingKey', *OUTLIER_FIELDS)}), {_sequential('ClosePrice')} select ListingKey from t3",
    "sold_final": SOLD_PIPELINE + f"select {FINAL_COLUMNS}, close_year, close_month, close_yrmo from final",
    "sold_final_ledger": SOLD_PIPELINE
    + _ledger(
        [
            ("outlier", "not (ClosePrice_outlier_flag or LivingArea_outlier_flag or DaysOnMarket_outlier_flag)"),
            ("region", REGION),
            ("postal", f"not {BAD_ZIP}"),
        ],
        "flagged",
    ),
    "sold_key_stats": SOLD_PIPELINE + _key_stats(["ClosePrice", "price_per_sqft", "DaysOnMarket", "mortgage_rate_30yr"], "final"),
    "sold_cleaned_flags": SOLD_PIPELINE + _summary(FLAG_SQL, "cleaned"),
    "listed_final": LISTED_PIPELINE + f"select {FINAL_COLUMNS}, listing_year, listing_month, listing_yrmo from final",
    "listed_segments": LISTED_PIPELINE
    + f"""select CountyOrParish, count(ListPrice) as listing_count, {r('median(ListPrice)', 4)} as median_list_price,
    {r('median(price_per_sqft)', 4)} as median_price_per_sqft, {r('median(price_ratio)', 4)} as median_price_ratio,
    {r('median(DaysOnMarket)', 4)} as median_dom, {r('median(listing_to_contract_days)', 4)} as median_list_to_contract
    from featured where CountyOrParish is not null group by 1""",
    "quick_sold": _quick("ClosePrice", "PricePerSqFt", parts("CloseDate", "CloseYear", "CloseMonth", "YrMo")),
    "quick_listed": _quick("ListPrice", "ListPricePerSqFt", parts("ListingContractDate", "ListYear", "ListMonth", "YrMo")),
    "monthly_csv": _s("ListingKey", "ClosePrice", "CountyOrParish", "CloseDate")
    + """select coalesce(strftime(CloseDate, '%Y%m'), '190001') as month, count(*) as rows,
    count(CountyOrParish) as counties, min(ClosePrice) as lowest, max(ClosePrice) as highest from s group by 1""",
    "closed_month_pages": _s("ListingKey", "MlsStatus", "CloseDate", "ClosePrice", "PropertyType")
    + """select ListingKey, ClosePrice, PropertyType from s
    where MlsStatus = 'Closed' and CloseDate >= date '1995-03-01' and CloseDate < date '1995-04-01'""",
    "listing_month_pages": _s("ListingKey", "ListingContractDate", "ListPrice")
    + """select ListingKey, ListPrice, null::varchar as City from s
    where ListingContractDate >= date '1995-03-01' and ListingContractDate < date '1995-04-01'""",
    "pages_to_monthly_sold": _s("ListingKey", "MlsStatus", "CloseDate", "ClosePrice", "PropertyType")
    + """select ListingKey, ClosePrice as price, PropertyType, null::varchar as City from s
    where MlsStatus = 'Closed' and CloseDate >= date '1995-03-01' and CloseDate < date '1995-04-01'""",
    "pages_to_monthly_listed": _s("ListingKey", "ListingContractDate", "ListPrice", "PropertyType")
    + """select ListingKey, ListPrice as price, PropertyType, null::varchar as City from s
    where ListingContractDate >= date '1995-03-01' and ListingContractDate < date '1995-04-01'""",
    "monthly_header_copies": _s("ListingKey", "PropertyType")
    + "select ListingKey, PropertyType, 'third' as third, 3 as columns from s",
    "single_file_schema": _s("CloseDate")
    + " union all ".join(
        f"""select {i} as position, '{c}' as "column", 'string' as type, count(*) as rows, 4 as columns
        from s where year(CloseDate) = 1995"""
        for i, c in enumerate(["ListingKey", "ClosePrice", "CloseDate", "source_file"], 1)
    ),
    "ragged_csv": _s("ListingKey", "CountyOrParish", "DaysOnMarket")
    + """, t as (select ListingKey, '"' || coalesce(CountyOrParish, '') || ', area"' as county, cast(DaysOnMarket as bigint) as n from s)
    select case when n % 7 = 0 then 3 when n % 11 = 0 then 1 else 2 end as cells,
    case when n % 7 = 0 then ListingKey || ',' || county || ',more' else ListingKey end as record from t""",
    "short_records_filled": _s("ListingKey", "StateOrProvince", "PropertyType")
    + """select ListingKey, case when PropertyType is not null and trim(StateOrProvince) <> '' then StateOrProvince
    when PropertyType is not null and StateOrProvince <> '' then StateOrProvince end as State, PropertyType as Type from s""",
    "latin1_header": _s("ListingKey", "CountyOrParish")
    + "select ListingKey as key, 'Évry ' || coalesce(CountyOrParish, '?') as county from s",
    "multiline_header": _s("ListingKey", "StateOrProvince")
    + "select ListingKey as key, case when StateOrProvince <> '' then StateOrProvince end as State, 3 as columns from s",
    "export_types": _s("ListingKey", "ClosePrice", "DaysOnMarket", "YearBuilt", "CountyOrParish", "CloseDate")
    + """, t as (select ListingKey, ClosePrice::varchar as ClosePrice, DaysOnMarket::bigint::varchar as DaysOnMarket,
        YearBuilt::bigint::varchar as YearBuilt, CountyOrParish, CloseDate::varchar as CloseDate from s),
    kinds as ("""
    + " union all ".join(
        f"""select {i} as position, '{c}' as "column", count(*) as rows,
        case when count({c}) filter (where try_cast({c} as bigint) is null or contains({c}, '.') or contains({c}, 'e')) = 0 then 'bigint'
        when count({c}) filter (where try_cast({c} as double) is null) = 0 then 'double' else 'string' end as type from t"""
        for i, c in enumerate(["ListingKey", "ClosePrice", "DaysOnMarket", "YearBuilt", "CountyOrParish", "CloseDate"], 1)
    )
    + """) select *, 6 as columns, type = 'string' as is_text from kinds""",
    "page_chains": _s("ListingKey")
    + """, orders_seen as (select distinct l_orderkey as o from lineitem),
    linked as (select o, lead(o) over (partition by o // 1000 order by o) as next from orders_seen)
    select 'record' as kind, ListingKey as what from s
    union all select 'dangling', 'page/' || next from linked where o % 7 <> 0 and next % 7 = 0""",
    "corrected_month": _s("ListingKey", "ListPrice", "CloseDate")
    + """select ListingKey, ListPrice * case when month(CloseDate) = 2 then 2 else 1 end as ListPrice, strftime(CloseDate, '%Y%m') as month,
    '199501,199502 199502,199503 ' as runs from s where year(CloseDate) = 1995 and month(CloseDate) <= 3""",
    "odd_cells_csv": _s("ListingKey", "StateOrProvince") + ODD_CELLS,
    "odd_cells_month": _s("ListingKey", "StateOrProvince") + ODD_CELLS,
    "missing_report_file": _s() + _missing(SALES),
    "numeric_report_file": _s() + _profile(["ClosePrice", *PROFILE]),
    "listing_in_future": _s("ListingContractDate", "CloseDate")
    + f""", t as (select ListingContractDate + cast(11000 as int) as l, CloseDate as c from s),
    n as (select count(*) filter (where c is not null and l is not null) as close_and_listing,
    count(*) filter (where c < l) as close_before_listing, count(*) filter (where l > current_date) as listing_in_future from t)
    select close_and_listing, close_before_listing, {pct('close_before_listing', 'greatest(close_and_listing, 1)', 2)} as close_before_listing_pct,
    listing_in_future from n""",
    "sold_stages": SOLD_PIPELINE
    + """, c as (select count(*) as n from s where PropertyType = 'Residential')
    select 'combined' as stage, n as rows from c union all select 'enriched', n from c
    union all select 'cleaned', count(*) from cleaned union all select 'flagged', count(*) from flagged
    union all select 'final', count(*) from final
    union all select 'flagged_month', count(*) from flagged where close_yrmo = '1995-03'
    union all select 'final_month', count(*) from final where close_yrmo = '1995-03'""",
}
ORACLES["segment_report_file"] = ORACLES["segment_summary"]
ORACLES["quick_sold_file"] = ORACLES["quick_sold"]
_AGAIN = "'199502 0' as again"
ORACLES["kept_fences"] = f"select *, {_AGAIN} from ({ORACLES['iqr_fences']})"
ORACLES["kept_profile"] = f"select *, {_AGAIN} from ({ORACLES['numeric_profile']})"
ORACLES["kept_segments"] = _s("CountyOrParish", "ClosePrice") + f"""select CountyOrParish, {r('median(ClosePrice)', 4)} as median_close_price,
count(ClosePrice) as sale_count, {_AGAIN} from s where CountyOrParish is not null group by 1"""
