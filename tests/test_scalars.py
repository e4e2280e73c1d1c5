import datetime

import pytest
from pyspark.sql import functions as F

from tabkit import functions as f


def values(spark, rows, *columns, schema="c string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.coalesce(1).select(*columns).collect()]


def test_num_accepts_plain_and_scientific_numbers_only(spark):
    texts = ["12", " 12.5 ", "-.5", "1e3", "12d", "12f", "1,000", "N/A", "NaN", "Infinity", "0x1p3", ".", "", None]
    assert values(spark, texts, f.num("c")) == [12.0, 12.5, -0.5, 1000.0] + [None] * 10


def test_to_day_needs_a_full_valid_date(spark):
    day = datetime.date(2024, 1, 31)
    texts = ["2024-01-31", " 2024-01-31 ", "2024-13-01", "2024-02-30", "2024", "", "2024-01-31T00:00:00Z", None]
    assert values(spark, texts, f.to_day("c")) == [day, day, None, None, None, None, day, None]


def test_to_moment_takes_an_optional_time(spark):
    texts = ["2024-01-31", "2024-01-31 10:20:30", "2024-01-31T10:20:30.500Z", "2024-01-31T10", "x"]
    got = values(spark, texts, F.date_format(f.to_moment("c"), "yyyy-MM-dd HH:mm:ss.SSS"))
    assert got == ["2024-01-31 00:00:00.000", "2024-01-31 10:20:30.000", "2024-01-31 10:20:30.500", None, None]


def test_strict_day_raises(spark):
    assert values(spark, ["2024-01-31"], f.strict_day("c")) == [datetime.date(2024, 1, 31)]
    with pytest.raises(Exception):
        values(spark, ["2024-13-01"], f.strict_day("c"))


def test_round_even_breaks_ties_to_even(spark):
    assert values(spark, [0.125, 0.375, -0.125, 2.5, None], f.round_even("c", 2), schema="c double") == [
        0.12, 0.38, -0.12, 2.5, None,
    ]
    assert values(spark, [0.5, 1.5, 2.5], f.round_even("c", 0), schema="c double") == [0.0, 2.0, 2.0]


def test_clip_keeps_nulls(spark):
    assert values(spark, [0.1, 0.7, 150.0, None], f.clip("c", 0.5, 1.5), schema="c double") == [0.5, 0.7, 1.5, None]


def test_missing_texts_and_sentinel(spark):
    texts = ["", "NA", "N/A", "nan", "null", "None", "#N/A", "na", "None ", "x", None]
    assert values(spark, texts, f.normalise_missing("c")) == [None] * 7 + ["na", "None ", "x", None]
    assert values(spark, [".", "6.5", None], f.null_if("c", ".")) == [None, "6.5", None]


def test_zip5_and_blank(spark):
    codes = ["90210-1234", "02138", "bad", "9021", None]
    assert values(spark, codes, f.zip5("c")) == [90210, 2138, None, None, None]
    assert values(spark, ["", "  ", None, "CA"], f.blank("c")) == [True, True, True, False]


def test_ratio_percent_and_prefer(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (None, 2.0)]
    schema = "a double, b double"
    assert values(spark, rows, f.quotient("a", "b"), schema=schema) == [0.5, None, None]
    assert values(spark, rows, f.percent_of("a", "b"), schema=schema) == [50.0, None, None]
    assert values(spark, rows, f.prefer("a", F.col("a") > 0, "b"), schema=schema) == [1.0, 1.0, 2.0]


def test_date_parts(spark):
    rows = [("2024-02-29", "2024-03-02"), (None, "2024-03-02"), ("2024-03-05", "2024-03-02")]
    day = [f.to_day("s"), f.to_day("e")]
    got = values(spark, rows, f.month_key(day[0]), f.year_number(day[0]), f.month_number(day[0]),
                 f.days_between(day[1], day[0]), schema="s string, e string")
    assert got == [("2024-02", 2024, 2, 2), (None, None, None, None), ("2024-03", 2024, 3, -3)]
