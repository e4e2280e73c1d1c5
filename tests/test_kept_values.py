import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.operators import outliers as O
from tabkit.operators import profile as P
from tabkit.operators import segment as G
from tabkit.operators.distribution import distribution
from tabkit.streaming import kept_values
from tabkit.streaming.kept_values import KeptValues

PROBABILITIES = [0.0, 0.25, 0.5, 0.9, 1.0]
FIELDS = ["price", "days", "none"]


def rows_of(month, n=200, shift=0.0):
    rng = np.random.default_rng(month)
    price = np.round(rng.lognormal(12, 1, n) + shift, 2)
    price[: n // 3] = 500_000.0
    days = rng.integers(-5, 90, n)
    return [
        (f"2024{month:02d}", ["hot", "hot", "a", None, "b"][i % 5], None if i % 11 == 5 else float(price[i]), None if i % 7 == 1 else int(days[i]), float("nan"))
        for i in range(n)
    ]


@pytest.fixture
def land(spark, tmp_path):
    def write(rows, mode="append"):
        df = spark.createDataFrame(rows, "month string, area string, price double, days int, none double")
        for (month,) in df.select("month").distinct().collect():
            df.where(F.col("month") == month).drop("month").write.mode(mode).parquet(f"{tmp_path}/t/month={month}")
        return f"{tmp_path}/t"

    return write


def same(got, want, keys=()):
    order = [*keys, "field"]
    assert got.columns == want.columns
    a, b = (sorted((tuple(r) for r in df.collect()), key=str) for df in (got, want))
    assert len(a) == len(b), order
    for x, y in zip(a, b, strict=True):
        assert x[: len(order) + 3] == y[: len(order) + 3]
        # Sums of a cell are whole numbers, so means are equal to the last bit.
        assert x[len(order) + 3] == y[len(order) + 3]
        assert (x[-1] is None) == (y[-1] is None)
        if x[-1] is not None:
            np.testing.assert_allclose(x[-1], y[-1], rtol=1e-13, atol=0)


def test_equal_to_a_full_run_as_months_come_and_change(spark, tmp_path, land):
    table = land([r for m in (1, 2, 3) for r in rows_of(m)])
    flat, grouped = (KeptValues(spark, f"{tmp_path}/{n}", FIELDS, keys) for n, keys in (("flat", []), ("grouped", ["area"])))

    def check(months):
        assert flat.refresh(table) == grouped.refresh(table) == months
        assert flat.refresh(table) == []
        df = spark.read.option("mergeSchema", True).parquet(table)
        for limits in ({}, {"dense_rows": 5, "broadcast_rows": 0})[len(months) < 3 :]:
            same(flat.distribution(FIELDS, PROBABILITIES, **limits), distribution(df, FIELDS, PROBABILITIES))
            got = grouped.distribution(FIELDS, PROBABILITIES, keep_empty=True, **limits)
            same(got, distribution(df, FIELDS, PROBABILITIES, ["area"], keep_empty=True), ["area"])

    check(["202401", "202402", "202403"])
    land(rows_of(4))
    land(rows_of(2, 300, 1e5), "overwrite")
    check(["202402", "202404"])
    land(rows_of(4, 50))  # a further file in a month
    land([("202401", None, None, None, None)], "overwrite")  # a month left without a value and without a group
    check(["202401", "202404"])
    spark.createDataFrame([("a", 7.5)], "area string, price double").write.mode("overwrite").parquet(f"{table}/month=202403")  # lacks columns
    check(["202403"])


def test_reports_from_stored_counts(spark, tmp_path, land):
    table = land([r for m in (1, 2) for r in rows_of(m)])
    kept = KeptValues(spark, f"{tmp_path}/k", FIELDS, ["area"])
    flat = KeptValues(spark, f"{tmp_path}/f", FIELDS)
    kept.refresh(table), flat.refresh(table)
    df = spark.read.parquet(table)
    rows = lambda frame: sorted(map(str, frame.collect()))
    assert rows(O.fences_of(flat.distribution(FIELDS, O.FENCE_PROBABILITIES))) == rows(O.iqr_fences(df, FIELDS))
    assert rows(P.profile_of(flat.distribution(FIELDS, P.PROFILE_PROBABILITIES))) == rows(P.numeric_profile(df, FIELDS))
    stats = kept.distribution(["price", "days"], [0.5], keep_empty=True)
    want = G.segment_summary(df, "area", {"m": "price", "d": "days"}, "price")
    assert rows(G.segments_of(stats, "area", {"m": "price", "d": "days"}, "price")) == rows(want)


def test_only_new_months_and_wanted_cells_are_read(spark, tmp_path, land, monkeypatch):
    table = land([r for m in (1, 2) for r in rows_of(m)])
    kept = KeptValues(spark, f"{tmp_path}/k", FIELDS)
    kept.refresh(table)
    seen = []
    kept.typed = lambda df: seen.extend(df.inputFiles()) or df
    land(rows_of(3))
    assert kept.refresh(table) == ["202403"]
    assert seen and all("month=202403" in f for f in seen)
    got = kept.distribution(["price"], [0.5]).collect()
    cells = spark.createDataFrame([("price", 194_000), ("price", 194_200), ("days", 0)], "_field string, _cell int")
    plan = kept._values_in(cells)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "And(EqualTo(_field,days),EqualTo(_cell,0))" in pushed and "And(EqualTo(_field,price),In(_cell" in pushed
    monkeypatch.setattr(kept_values, "FILTER_CELLS", 0)
    assert [tuple(r) for r in kept.distribution(["price"], [0.5]).collect()] == [tuple(r) for r in got]


def test_a_run_that_failed_is_made_good(spark, tmp_path, land, monkeypatch):
    table = land(rows_of(1))
    kept = KeptValues(spark, f"{tmp_path}/k", FIELDS)
    replace = kept._replace
    monkeypatch.setattr(kept, "_replace", lambda rows, name, order=(): replace(rows, name, order) if name == "values" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kept.refresh(table)
    monkeypatch.undo()
    assert kept.refresh(table) == ["202401"]
    same(kept.distribution(FIELDS, PROBABILITIES), distribution(spark.read.parquet(table), FIELDS, PROBABILITIES))


def test_nothing_stored_and_months_that_go(spark, tmp_path, land):
    kept = KeptValues(spark, f"{tmp_path}/k", ["price"])
    assert kept.refresh(f"{tmp_path}/t") == [] and kept.distribution(["price"], [0.5]).count() == 0
    land([r for m in (1, 2) for r in rows_of(m)])
    elsewhere = spark.read.parquet(f"{tmp_path}/t/month=202402")
    only = tmp_path / "u"
    elsewhere.write.parquet(f"{only}/month=202402")
    kept.refresh(f"{tmp_path}/t")
    # Another folder with the second month alone: the first is gone, the second another file.
    assert kept.refresh(str(only)) == ["202401", "202402"] and kept.refresh(str(only)) == []
    same(kept.distribution(["price"], PROBABILITIES), distribution(elsewhere, ["price"], PROBABILITIES))
    with pytest.raises(ValueError, match="not among"):
        kept.distribution(["days"], [0.5])
