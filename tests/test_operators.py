import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.functions import month_key
from tabkit.operators import clean as C
from tabkit.operators import enrich as E
from tabkit.operators import features as X
from tabkit.operators import flags as Q
from tabkit.operators import outliers as O
from tabkit.operators import profile as P
from tabkit.operators import segment as G


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


# Profiles

def test_missing_report_and_strict_threshold(spark):
    data = [("x" if i == 0 else None, None, "v" if i < 1 or i > 18 else None, str(i)) for i in range(20)]
    df = spark.createDataFrame(data, "mostly string, nothing string, ninety string, full string")
    assert rows(P.missing_report(df)) == [
        ("nothing", 20, 100.0), ("mostly", 19, 95.0), ("ninety", 18, 90.0), ("full", 0, 0.0),
    ]
    assert C.drop_high_missing(df, 90.0, keep=["mostly"]).columns == ["mostly", "ninety", "full"]


def test_frequency_keeps_null_and_breaks_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), (None,), (None,)], "c string")
    assert rows(P.frequency_table(df, "c")) == [(None, 3), ("a", 2), ("b", 1)]
    assert rows(P.category_share(df, "c", "a")) == [(6, 2, 33.3, 4, 66.7)]
    assert sorted(rows(C.complement_filter(df, "c", "a")), key=str) == [("b",), (None,), (None,), (None,)]
    assert len(rows(P.distinct_values(df, "c"))) == 3
    assert rows(C.filter_category(df, "c", "a")) == [("a",), ("a",)]


def test_numeric_profile_coerces_text_and_skips_empty_fields(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "N/A"), ("3", None), ("4", ""), ("bad", "y")], "n string, e string")
    q = [round(float(np.quantile([1, 2, 3, 4], p)), 2) for p in (0.25, 0.5, 0.75, 0.9, 0.99)]
    assert rows(P.numeric_profile(df, ["n", "e", "absent"])) == [
        ("n", 4, 1.0, q[0], q[1], 2.5, q[2], q[3], q[4], 4.0)
    ]
    assert rows(P.center_and_skew(df, "n")) == [(2.5, 2.5, 0.0)]
    assert rows(P.key_stats(df, ["n", "e"])) == [("n", 2.5, 2.5, 1.0, 4.0)]


def test_price_comparisons(spark):
    df = spark.createDataFrame(
        [(110.0, 100.0), (100.0, 100.0), (90.0, 100.0), (None, 100.0), (5.0, 0.0), (5.0, None)], "a double, b double"
    )
    assert rows(P.above_at_below(df, "a", "b"), "valid", "above", "at", "below", "above_pct") == [(3, 1, 1, 1, 33.3)]
    cuts = spark.createDataFrame(
        [(1_000_000.0, 999_999.0), (100.0, 90.0), (100.0, 100.0), (100.0, 120.0), (0.0, 5.0)], "o double, l double"
    )
    # A cut below 0.005% counts as unchanged.
    got = P.price_change_buckets(cuts, "o", "l")
    assert rows(got, "valid", "reduced", "unchanged", "raised", "mean_reduction_pct") == [(4, 1, 2, 1, 10.0)]


def test_date_checks(spark):
    df = spark.createDataFrame(
        [
            ("2024-02-01", "2024-01-01", "2024-01-15"),
            ("2024-01-01", "2024-02-01", "2024-01-15"),
            ("2024-01-01", "2024-01-01", None),
            (None, "2030-01-01", "2024-01-15"),
            ("bad", "2024-01-01", "2024-01-01"),
        ],
        "close string, listing string, purchase string",
    )
    assert rows(P.date_order_counts(df, "close", "listing", "purchase")) == [(3, 1, 33.33, 2, 1, 50.0)]
    assert rows(P.listing_date_issues(df, "listing", "close", as_of="2026-01-01")) == [(3, 1, 33.33, 1)]
    none = P.listing_date_issues(df.where("close is null"), "listing", "close", as_of="2026-01-01")
    assert rows(none) == [(0, 0, 0.0, 1)]
    span = P.dataset_span(df, "listing")
    assert rows(span) == [(5, 3, datetime.date(2024, 1, 1), datetime.date(2030, 1, 1))]


def test_schema_description(spark):
    df = spark.createDataFrame([(1, "a")], "n int, t string")
    assert rows(P.describe_schema(df)) == [(1, "n", "int", 1, 2), (2, "t", "string", 1, 2)]
    assert P.text_columns(df) == ["t"]
    assert P.select_existing(df, ["t", "absent"]).columns == ["t"]


# Segments

def test_segment_summary_keeps_empty_segments_and_drops_null_keys(spark):
    df = spark.createDataFrame(
        [("a", 10.0, 1.0), ("a", 20.0, None), ("a", None, 3.0), ("b", None, None), (None, 99.0, 9.0), ("c", 15.0, None)],
        "k string, v double, w double",
    )
    summary = G.segment_summary(df, "k", {"mv": "v", "mw": "w", "mx": "absent"}, "v", "n")
    ordered = G.order_by_desc(summary, "mv", "k")
    assert rows(ordered, "k", "n", "mv", "mw") == [
        ("a", 2, 15.0, 2.0), ("c", 1, 15.0, None), ("b", 0, None, None),  # ties by key, nulls last
    ]
    assert rows(G.top_k(G.group_center(df, "k", "v"), "median", "k", 1)) == [("a", 15.0, 2)]
    assert rows(G.group_total(summary)) == [(3,)]


# Flags

def test_timeline_flags_are_never_null(spark):
    df = spark.createDataFrame(
        [("2024-02-01", "2024-01-05", "2024-01-01"), ("2024-01-01", "2024-01-01", "2024-01-01"), (None, "2024-03-01", "2024-01-01")],
        "l string, p string, c string",
    ).select(*[F.to_date(x).alias(x) for x in "lpc"])
    got = Q.timeline_flags(df, "l", "p", "c").drop("l", "p", "c")
    assert rows(got) == [(True, True, True), (False, False, False), (False, True, True)]
    assert Q.timeline_flags(df.select("l"), "l", "p", "c").columns == ["l"]


def test_coordinate_and_postal_flags(spark):
    points = [(0.0, 0.0), (34.0, 118.0), (None, -118.0), (32.5, -124.5), (42.1, -114.1), (42.11, -118.0), (34.0, -118.0)]
    df = spark.createDataFrame(points, "Latitude double, Longitude double")
    got = rows(Q.coord_flags(df).drop("Latitude", "Longitude").coalesce(1))
    assert got == [
        (False, True, False, True), (False, False, True, True), (True, False, False, False),
        (False, False, False, False), (False, False, False, False), (False, False, False, True),
        (False, False, False, False),
    ]
    codes = spark.createDataFrame([(c,) for c in ["90001", "96162", "96163", "90210-1234", "02138", "bad", None]], "PostalCode string")
    flagged = rows(Q.code_range_flag(codes).coalesce(1), "non_ca_postal_flag")
    assert flagged == [(False,), (False,), (True,), (False,), (True,), (False,), (False,)]
    assert Q.drop_out_of_band_postal(codes).count() == 5


def test_region_uses_the_box_only_without_a_state(spark):
    cases = [("CA", None, None), (" CA ", 34.0, -118.0), (" ", 34.0, -118.0), (None, 42.0, -124.0), (None, 42.05, -118.0), ("AZ", 34.0, -118.0), (None, None, None)]
    df = spark.createDataFrame(cases, "StateOrProvince string, Latitude double, Longitude double")
    assert rows(Q.in_region(df)) == [cases[0], cases[2], cases[3]]
    assert Q.in_region(df.select("Latitude", "Longitude")).count() == 4  # an absent state counts as missing
    assert Q.in_region(df.select("StateOrProvince")).count() == 1


def test_drop_flagged(spark):
    df = spark.createDataFrame([(1, True, False), (2, False, None), (3, False, True)], "i int, f boolean, g boolean")
    assert rows(Q.drop_flagged(df, ["f", "g", "h"]), "i") == [(2,)]
    assert Q.drop_flagged(df, ["h"]).count() == 3
    assert rows(P.flag_summary(df, ["f", "g", "h"])) == [("f", 1, 33.33), ("g", 1, 33.33)]


# Outliers

def test_flags_use_the_whole_set_and_the_filter_the_trimmed_set(spark):
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(100, 5, 200), [1000.0] * 20])
    b = np.concatenate([rng.normal(50, 2, 200), [90.0] * 20])
    data = [(int(i), float(a[i]), float(b[i])) for i in range(220)] + [(220, None, 50.0), (221, 100.0, None)]
    df = spark.createDataFrame(data, "i int, a double, b double")

    def fences(x):
        q1, q3 = np.quantile(x, [0.25, 0.75])
        return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)

    flagged = O.outlier_flags(df, ["a", "b", "absent"])
    assert flagged.columns == ["i", "a", "b", "a_outlier_flag", "b_outlier_flag"]
    lo, hi = fences([r[1] for r in data if r[1] is not None])
    want = {r[0] for r in data if r[1] is not None and not lo <= r[1] <= hi}
    assert {r["i"] for r in flagged.where("a_outlier_flag").collect()} == want
    assert flagged.count() == len(data)

    kept = data
    for position in (1, 2):
        lo, hi = fences([r[position] for r in kept if r[position] is not None])
        kept = [r for r in kept if r[position] is not None and lo <= r[position] <= hi]
    assert {r["i"] for r in O.iqr_filter_sequential(df, ["a", "b"]).collect()} == {r[0] for r in kept}

    shift = {r["field"]: r for r in O.median_shift(flagged, ["a", "b"], ["a_outlier_flag", "b_outlier_flag"]).collect()}
    assert shift["a"]["median_before"] == round(float(np.median([r[1] for r in data if r[1] is not None])), 2)


def test_constant_and_empty_fields_for_fences(spark):
    df = spark.createDataFrame([(7.0, None), (7.0, None), (8.0, None), (7.0, None), (7.0, None)], "a double, e double")
    assert rows(O.iqr_fences(df, ["a", "e"])) == [("a", 7.0, 7.0, 0.0, 7.0, 7.0)]
    assert [r["a_outlier_flag"] for r in O.outlier_flags(df, ["a", "e"]).coalesce(1).collect()] == [False, False, True, False, False]
    assert O.iqr_fences(df, ["absent"]).count() == 0
    assert O.iqr_filter_sequential(df, ["e"]).count() == 0


# Cleaning

def test_ledger_counts_each_row_under_its_first_failure(spark):
    df = spark.createDataFrame(
        [(None, 0.0, 1.0), (5.0, 0.0, 1.0), (5.0, None, -1.0), (0.0, 9.0, 1.0), (5.0, 9.0, None)], "p double, a double, d double"
    )
    rules = [C.require_positive("p"), C.null_or_positive("a"), C.null_or_nonneg("d"), C.null_or_nonneg("absent")]
    assert rows(C.row_ledger(df, rules), "rows_before", "removed", "rows_after") == [(5, 2, 3), (3, 1, 2), (2, 1, 1)]
    assert rows(C.apply_rules(df, rules)) == [(5.0, 9.0, None)]


def test_coercion_report(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("x", "2024-13-01"), (None, None)], "n string, d string")
    typing = C.Typing(dates=["d"], numbers=["n", "absent"])
    assert sorted(rows(C.coercion_report(df, typing))) == [("d", 1), ("n", 1)]
    assert dict(C.coerce(df, typing).dtypes) == {"n": "double", "d": "date"}


# Features and enrichment

def test_ratio_guard_rounding_and_clip(spark):
    df = spark.createDataFrame([(500.0, 1000.0), (1500.0, 1000.01), (999.0, 100_000.0), (None, 2000.0), (5.0, 0.0)], "n double, d double")
    got = rows(df.select(X.guarded_ratio("n", "d", 1000, 4, (0.5, 1.5)), X.guarded_ratio("n", "d", 0, 2)).coalesce(1))
    assert got == [(None, 0.5), (1.5, 1.5), (0.5, 0.01), (None, None), (None, None)]


def test_monthly_series_is_dense_and_join_keeps_rows(spark):
    from tabkit.sources.rates import typed_series

    raw = spark.createDataFrame(
        [("2024-01-04", "6.62"), ("2024-01-11", "6.66"), ("2024-02-01", "."), ("2024-03-07", "6.88")], "x string, y string"
    )
    series = typed_series(raw)
    assert series.count() == 3
    monthly = E.resample_monthly(series)
    assert sorted(rows(monthly)) == [("2024-01", 6.64), ("2024-02", None), ("2024-03", 6.88)]
    assert rows(E.series_range(series)) == [(3, datetime.date(2024, 1, 4), datetime.date(2024, 3, 7), 6.62, 6.88)]
    assert [r[0] for r in G.last_k(monthly, "year_month", 2).collect()] == ["2024-03", "2024-02"]
    df = spark.createDataFrame([("2024-01-31",), ("2024-02-01",), (None,), ("bad",), ("2030-01-01",)], "d string")
    rich = E.enrich_monthly_rate(df, monthly, "d")
    assert rows(P.null_check(rich, E.RATE)) == [(5, 4)]
    without = E.enrich_or_null(df, None, "d")
    assert rows(P.null_check(without, E.RATE)) == [(5, 5)]
    assert without.where(month_key(F.to_date(F.lit("2024-01-31"))) == F.col("year_month")).count() == 1


def test_reports_take_absent_columns(spark):
    from tabkit.functions import num
    from tabkit.plans.config import SOLD
    from tabkit.plans.pipeline import row_rules, segment_report

    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert P.numeric_profile(df, ["no"]).collect() == [] == P.key_stats(df, ["no"]).collect()
    assert P.center_and_skew(df, "no").collect() == [] == P.value_distribution(df, "no").collect()
    assert P.flag_summary(df, ["no"]).collect() == [] == P.missing_report(df, []).collect()
    assert C.coercion_report(df, C.Typing(numbers=["no"])).collect() == [] == C.row_ledger(df, row_rules(SOLD)).collect()
    assert segment_report(df, SOLD).collect() == []
    named = df.withColumn("CountyOrParish", num("b").cast("string")).fillna("one", ["CountyOrParish"])
    assert segment_report(named, SOLD).first()["sale_count"] == 0
    assert P.above_at_below(df, "no", "neither").first()["valid"] == 0
    assert P.price_change_buckets(df, "no", "neither").first()["valid"] == 0
    assert P.date_order_counts(df, "x", "y", "z").first()["close_and_listing"] == 0
    assert P.listing_date_issues(df, "x", "y", "2024-01-01").first()["listing_in_future"] == 0
    assert P.dataset_span(df, "x").first()["first_date"] is None and P.null_check(df, "x").first()["null_rows"] == 1


def test_series_with_small_values_and_bad_dates(spark):
    small = spark.createDataFrame([("2024-01-04", 1e-9), ("2024-01-11", 3e-9)], "date string, v double")
    assert E.resample_monthly(small, value="v", digits=12).first()["v"] == 2e-9
    with pytest.raises(ValueError):
        E.resample_monthly(small, value="v", digits=6, scale=4)
    bad = spark.createDataFrame([(None, 1.0), ("2024-01-11", 3.0)], "date string, v double")
    with pytest.raises(Exception, match="without a valid date"):
        E.resample_monthly(bad, value="v").collect()
    assert E.resample_monthly(bad.where("date is not null").unionByName(spark.createDataFrame([(None, None)], "date string, v double")), value="v").count() == 1
