import csv
import datetime

import pytest

from tabkit.operators import outliers as O
from tabkit.operators import profile as P
from tabkit.plans.config import LISTED, QUICK_SOLD_DROPPED, SOLD
from tabkit.plans.pipeline import quick_missing, run_pipeline, run_quick
from tabkit.sources import monthly as M
from tabkit.sources import rates as R

COLUMNS = """ListingKey PropertyType MlsStatus ClosePrice ListPrice OriginalListPrice LivingArea DaysOnMarket
BedroomsTotal BathroomsTotalInteger CloseDate PurchaseContractDate ListingContractDate ContractStatusChangeDate
CountyOrParish StateOrProvince PostalCode Latitude Longitude ListAgentEmail BuilderName""".split()


def record(i, **changes):
    month = 1 + i % 2
    row = {
        "ListingKey": f"k{i}", "PropertyType": "Residential", "MlsStatus": "Closed",
        "ClosePrice": str(500_000 + 1000 * i), "ListPrice": str(495_000 + 1000 * i), "OriginalListPrice": str(510_000 + 1000 * i),
        "LivingArea": str(1500 + 10 * i), "DaysOnMarket": str(10 + i % 20), "BedroomsTotal": "3", "BathroomsTotalInteger": "2",
        "CloseDate": f"2024-0{month}-20", "PurchaseContractDate": f"2024-0{month}-05", "ListingContractDate": f"2024-0{month}-01",
        "ContractStatusChangeDate": f"2024-0{month}-20 10:00:00",
        "CountyOrParish": "Alpha" if i % 3 else "Beta", "StateOrProvince": "CA", "PostalCode": "90210",
        "Latitude": "34.0", "Longitude": "-118.0", "ListAgentEmail": "x@y", "BuilderName": "b" if i == 0 else "",
    }
    return row | changes


RECORDS = [record(i) for i in range(40)] + [
    record(40, PropertyType="Land"),
    record(41, PropertyType=""),
    record(42, ClosePrice="", ListPrice="", LivingArea="0"),  # fails two rules, counted once
    record(43, ClosePrice="N/A", ListPrice="12d"),
    record(44, DaysOnMarket="-1"),
    record(45, ClosePrice="90000000", ListPrice="90000000"),  # outlier
    record(46, StateOrProvince="AZ"),
    record(47, StateOrProvince=" ", Latitude="", Longitude=""),
    record(48, PostalCode="02138"),
    record(49, CloseDate="2024-13-01"),
    record(50, PurchaseContractDate="2024-06-01"),
]


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    for month, rows in (("202401", RECORDS[::2]), ("202402", RECORDS[1::2])):
        with open(folder / f"Sold{month}.csv", "w", newline="") as handle:
            writer = csv.DictWriter(handle, COLUMNS if month == "202401" else COLUMNS[::-1])
            writer.writeheader()
            writer.writerows(rows)
    (folder / "Sold_Cleaned.csv").write_text("ListingKey,PropertyType\nz,Residential\n")
    (folder / "rates.csv").write_text("observation_date,X\n2024-01-04,6.62\n2024-01-11,6.66\n2024-02-01,.\n")
    return str(folder)


@pytest.fixture(scope="module")
def raw(spark, source):
    return M.read_monthly_csv(spark, M.discover_monthly(spark, source, "Sold"))


@pytest.fixture(scope="module")
def sold(spark, raw, source, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    rates = R.read_rate_series(spark, f"{source}/rates.csv")
    return out, run_pipeline(raw, SOLD, rates, out)


def test_sold_stages(sold):
    _, run = sold
    assert run.combined.count() == 49
    assert run.enriched.count() == 49
    assert run.cleaned.count() == run.flagged.count() == 46
    keys = {r["ListingKey"] for r in run.final.collect()}
    assert keys == {f"k{i}" for i in [*range(40), 49, 50]}
    assert "BuilderName" not in run.cleaned.columns and "ListAgentEmail" not in run.cleaned.columns
    assert dict(run.final.dtypes)["ContractStatusChangeDate"] == "timestamp"
    assert all(dict(run.final.dtypes)[f] == "boolean" for f in run.final.columns if f.endswith("_flag"))


def test_sold_reports(sold):
    _, run = sold

    def report(name):
        return [tuple(r) for r in run.report(name).collect()]

    assert dict(report("category_before")) == {"Residential": 49, "Land": 1, None: 1}
    assert report("category_share") == [(51, 49, 96.1, 2, 3.9)]
    assert [r[2:] for r in report("row_ledger")][:3] == [(49, 2, 47), (47, 0, 47), (47, 1, 46)]
    assert dict(report("coercion"))["CloseDate"] == 1 and dict(report("coercion"))["ListPrice"] == 1
    assert {r[0]: r[1] for r in report("quality_flags")}["purchase_after_close_flag"] == 1
    assert report("rate_check") == [(49, 24)]  # the 24 rows with odd numbers close in a month without rate or have a bad date
    assert [r[1:] for r in report("final_ledger")] == [("outlier", 46, 1, 45), ("region", 45, 2, 43), ("postal", 43, 1, 42)]
    assert report("rate_range")[0][0] == 2 and report("last_rates") == [("2024-01", 6.64)]
    assert report("final_span")[0][0] == 42
    assert {r[0] for r in report("key_stats")} == {"ClosePrice", "price_per_sqft", "DaysOnMarket", "mortgage_rate_30yr"}
    assert report("missing_values")[0][0] == "BuilderName"
    for name in run.reports():
        assert run.report(name).columns
    flagged = run.flagged.where("ListingKey = 'k3'").first()
    assert flagged["price_ratio"] == round(503 / 513, 4) == flagged["close_to_original_list_ratio"]
    assert (flagged["close_year"], flagged["close_month"], flagged["close_yrmo"]) == (2024, 2, "2024-02")
    assert (flagged["listing_to_contract_days"], flagged["contract_to_close_days"]) == (4, 15)


def test_report_files_have_the_expected_headers(spark, sold):
    out, _ = sold
    headers = {
        "sold_missing_value_report": ",missing_count,missing_pct",
        "sold_numeric_distribution": "field,count,min,p25,median,mean,p75,p90,p99,max",
        "sold_county_summary": "CountyOrParish,sale_count,median_close_price,median_price_per_sqft,"
        "median_price_ratio,median_dom,median_list_to_contract",
    }
    for name, header in headers.items():
        assert spark.read.text(f"{out}/reports/{name}").first()[0] == header


def test_listed_differs_from_sold(spark, raw, tmp_path):
    run = run_pipeline(raw, LISTED, None, str(tmp_path / "out"), as_of="2024-01-31", stage_format="csv")
    assert run.cleaned.count() == 46  # the rows without list price and the negative days
    one = run.flagged.where("ListingKey = 'k3'").first()
    assert one["price_ratio"] == round(498 / 513, 4) and one["close_to_original_list_ratio"] == round(503 / 513, 4)
    assert one["listing_yrmo"] == "2024-02" and one["mortgage_rate_30yr"] is None
    assert [tuple(r) for r in run.report("date_order").collect()][0][3] == 24
    assert run.report("segment_summary").columns[1:3] == ["listing_count", "median_list_price"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/listed_final.csv").count() == run.final.count()


def test_quick_variant(spark, raw):
    with pytest.raises(ValueError):
        run_quick(raw, SOLD)  # strict drop: the columns must exist
    wide = raw.where("CloseDate <> '2024-13-01'")
    for name in QUICK_SOLD_DROPPED:
        wide = wide.withColumn(name, wide["CloseDate"])
    quick = run_quick(wide, SOLD)
    assert not set(QUICK_SOLD_DROPPED) & set(quick.columns)
    row = quick.where("ListingKey = 'k3'").first()
    assert row["PriceRatio"] == 503_000 / 498_000 and row["PricePerSqFt"] == 503_000 / 1530
    assert (row["CloseYear"], row["CloseMonth"], row["YrMo"]) == (2024, 2, "2024-02")
    listed = run_quick(wide, LISTED)
    assert {"ListPricePerSqFt", "ListYear", "ListMonth"} <= set(listed.columns)
    with pytest.raises(Exception):
        run_quick(raw, LISTED).collect()  # strict dates: a bad date fails
    assert "ListingKey" not in {r["column"] for r in quick_missing(raw, SOLD).collect()}


def test_lazy_run_gives_the_same_rows(spark, raw, source, sold):
    rates = R.read_rate_series(spark, f"{source}/rates.csv")
    lazy = run_pipeline(raw, SOLD, rates)
    written = sold[1]
    columns = written.final.columns
    assert sorted(map(str, lazy.final.select(columns).collect())) == sorted(map(str, written.final.collect()))


def test_reports_from_written_stages_equal_those_of_own_scans(spark, sold, raw, source):
    run = sold[1]
    lazy = run_pipeline(raw, SOLD, R.read_rate_series(spark, f"{source}/rates.csv"))
    for name in ("missing_values", "coercion", "row_ledger", "quality_flags", "rate_check"):
        assert sorted(map(tuple, run.report(name).collect())) == sorted(map(tuple, lazy.report(name).collect())), name
        assert run.report(name).columns == lazy.report(name).columns
    # Counted while a stage was written: nothing is scanned.
    for name in ("missing_values", "row_ledger", "quality_flags", "coercion", "rate_check"):
        plan = run.report(name)._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" not in plan.lower() and "csv" not in plan.lower(), name
    assert lazy.report("missing_values").count() == len(raw.columns)


def test_final_is_written_from_flagged_without_a_shuffle(spark, sold):
    out, run = sold
    months = {r[0] for r in run.final.select("close_yrmo").distinct().collect()}
    assert run.final.where("close_yrmo = '2024-02'").count() > 0 and len(months) >= 2


def test_quick_fences_read_the_typed_table(spark, raw):
    wide = raw.where("CloseDate <> '2024-13-01'")
    for name in QUICK_SOLD_DROPPED:
        wide = wide.withColumn(name, wide["CloseDate"])
    plan = run_quick(wide, SOLD)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "csv" not in plan
