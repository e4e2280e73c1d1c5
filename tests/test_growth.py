"""Steps that once took more time or memory than their rows need, held against the plainer form."""

import contextlib
import io
import time

import pytest
from pyspark.sql import functions as F

from bindings import views as V
from tabkit.functions import month_key
from tabkit.operators import clean as C
from tabkit.operators import enrich as E
from tabkit.plans.config import SOLD
from tabkit.plans.pipeline import TYPING, run_pipeline
from tabkit.session import cut_lineage, scratch_path
from tabkit.sources import monthly as M
from tabkit.sources import sinks as K


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_first_lines_are_found_without_sorting_all_lines(spark, tmp_path, monkeypatch):
    seen = []
    plain = M._openings
    monkeypatch.setattr(M, "_openings", lambda lines: seen.append(plain(lines)) or seen[-1])
    for k in range(12):
        (tmp_path / f"S20240{k:03}.csv").write_text(f"a{k},b\n" + "1,2\n" * (k * 50) + ('"x,2\ny",3\n' if k % 4 == 0 else ""))
    (tmp_path / "S2024900.csv").write_text('"c\nd",e\n1,2\n')
    (tmp_path / "S2024901.csv").write_text("")
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    looks = M.look_at_files(spark, paths)
    assert [looks[p] for p in paths[:12]] == [M.FileLook((f"a{k}", "b"), k % 4 == 0) for k in range(12)]
    assert looks[paths[12]] == M.FileLook(("c\nd", "e"), True) and paths[13] not in looks
    assert "HashAggregate" in plan_of(seen[0]) and "SortAggregate" not in plan_of(seen[0])


def test_first_lines_when_lines_are_numbered_anew(spark, tmp_path, monkeypatch):
    """The numbers of the first job fit no line of the second, or fit later lines too."""
    plain = M._openings
    (tmp_path / "S202401.csv").write_text("a,b\n1,2\n")
    (tmp_path / "S202402.csv").write_text("c,d\n" + "3,4\n" * 20)
    paths = [str(tmp_path / f"S20240{k}.csv") for k in (1, 2)]
    for shift in (-(1 << 40), 1 << 40):
        monkeypatch.setattr(M, "_openings", lambda lines, shift=shift: plain(lines).withColumn("upto", F.col("upto") + shift))
        assert [M.look_at_files(spark, paths)[p].header for p in paths] == [("a", "b"), ("c", "d")]


def test_file_names_come_from_the_end_of_the_path(spark, tmp_path):
    folder = tmp_path / "a b+c%20d" / "x=Sold 1+1"
    folder.mkdir(parents=True)
    (folder / "Sold 1+1%202024.csv").write_text("a\n1\n")
    (folder / "Sold200000.csv").mkdir()
    (folder / "Sold200000.csv" / "part-0.csv").write_text("a\n2\n")
    read = M.read_monthly_csv(spark, [str(folder / "Sold 1+1%202024.csv"), str(folder / "Sold200000.csv")], source="file")
    assert {(r.a, r.file) for r in read.collect()} == {("1", "Sold 1+1%202024.csv"), ("2", "Sold200000.csv")}
    assert "substring_index" in plan_of(read)


def test_coercion_is_counted_beside_the_typed_columns(spark):
    cells = [None, "", "1", " 2.5", "N/A", "12d", "2024-01-05", "2024-13-01", "x"]
    df = spark.createDataFrame([(a, b) for a in cells for b in cells], "ClosePrice string, CloseDate string").withColumn("rest", F.lit("r"))
    typed, counts, texts = C.coerce_beside(df, TYPING)
    assert typed.drop(*texts).exceptAll(C.coerce(df, TYPING)).isEmpty() and typed.drop(*texts).dtypes == C.coerce(df, TYPING).dtypes
    got = typed.agg(*[c.alias(name) for name, c in counts.items()]).first().asDict()
    assert got == {r["column"]: r["new_nulls"] for r in C.coercion_report(df, TYPING).collect()}
    assert not any("RLIKE" in str(c) for c in counts.values())


def test_month_keys_equal_the_formatter(spark):
    days = spark.sql("select date_add(date'0001-01-01', cast(id as int)) as d from range(-9000, 3700000, 41) union all select null")
    both = days.withColumn("t", F.expr("timestamp(d) + interval 23 hours"))
    for c in ("d", "t"):
        assert both.where(~month_key(c).eqNullSafe(F.date_format(c, "yyyy-MM"))).isEmpty()


def test_a_date_is_parsed_once_for_its_month(spark):
    df = spark.createDataFrame([("2024-02-03",), ("2024",), (None,)], "CloseDate string")
    keyed = E.enrich_or_null(df, None, "CloseDate")
    assert [r.year_month for r in keyed.collect()] == ["2024-02", None, None] and keyed.columns == ["CloseDate", "year_month", E.RATE]
    # Both the check of a text and its cast stand once in the plan.
    assert plan_of(keyed).count("RLIKE") == 1 or plan_of(keyed).count("rlike") == 1


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}


def test_shuffle_files_go_with_the_step_that_made_them(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = spark.range(2000).withColumn("month", F.concat(F.lit("m"), F.col("id") % 5))
    counted = df.groupBy("month").count()
    for step in (
        lambda: K.write_stage(df, str(tmp_path / "stage"), partition_by=["month"]),
        lambda: K.write_report(counted.orderBy("month"), str(tmp_path / "report")),
        lambda: cut_lineage(counted),
    ):
        before, setting = shuffle_files(spark), spark.conf.get(key)
        step()
        until = time.time() + 20
        while (left := shuffle_files(spark) - before) and time.time() < until:
            time.sleep(0.1)
        assert not left and spark.conf.get(key) == setting
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 2000 and sorted(r["count"] for r in cut_lineage(counted).collect()) == [400] * 5


def test_a_failed_stage_puts_the_setting_back(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    with pytest.raises(Exception, match="no such row"):
        K.write_stage(spark.range(3).withColumn("x", F.raise_error(F.lit("no such row"))), str(tmp_path / "stage"))
    assert spark.conf.get(key) == setting


def test_slices_are_all_rows_once_and_open_their_own_files(spark, tmp_path):
    made = spark.range(500).select(F.col("id").cast("int").alias("k"), F.expr("if(id % 7 = 0, null, concat('m', id % 3))").alias("month"))
    made.union(made.where("k < 20")).repartition(10).write.parquet(f"{tmp_path}/t")
    (tmp_path / "u").mkdir()
    for i, file in enumerate(sorted((tmp_path / "t").glob("part-*"))):
        (tmp_path / "u" / f"{i} +%20.parquet").write_bytes(file.read_bytes())  # names that Spark did not give
    rows = sorted(map(str, spark.read.parquet(f"{tmp_path}/t").collect()))
    for table in ("t", "u"):
        read = spark.read.parquet(f"{tmp_path}/{table}").withColumn("twice", F.col("k") * 2)
        opened = []
        for i in range(4):
            part = K._slice(read, i, 4)
            part.collect()
            opened.append(part._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value())
        assert sum(opened) == 10 and (table == "u" or sorted(opened) == [2, 2, 3, 3])
        # What stood there before goes, also in a session whose overwriting keeps other folders.
        spark.range(9).selectExpr("cast(id as int) k", "'old' as month", "0 as twice").write.partitionBy("month").parquet(f"{tmp_path}/out_{table}")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            K.write_stage(read, f"{tmp_path}/out_{table}", partition_by=["month"], slices=4)
        finally:
            spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
        back = spark.read.schema(read.schema).parquet(f"{tmp_path}/out_{table}")
        assert sorted(map(str, back.drop("twice").collect())) == rows and back.where("twice <> k * 2").isEmpty()
        assert (tmp_path / f"out_{table}" / "_SUCCESS").exists()


def test_a_column_that_hides_the_names_of_files_is_written_in_one_pass(spark, tmp_path):
    spark.range(40).selectExpr("id", "'m' as month", "'x' as _metadata").repartition(4).write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    K.write_stage(read, f"{tmp_path}/out", partition_by=["month"], slices=4)
    back = spark.read.schema(read.schema).parquet(f"{tmp_path}/out")
    assert back.where("_metadata = 'x'").count() == 40 and back.select("id").distinct().count() == 40


def test_a_table_cut_short_between_slices_is_not_marked_as_whole(spark, tmp_path):
    spark.range(40).selectExpr("id", "'m' as month").repartition(4).write.parquet(f"{tmp_path}/t")
    broken = spark.read.parquet(f"{tmp_path}/t").withColumn("x", F.when(F.expr("_metadata.file_name like 'part-00003%'"), F.raise_error(F.lit("torn"))))
    with pytest.raises(Exception, match="torn"):
        K.write_stage(broken, f"{tmp_path}/out", partition_by=["month"], slices=4)
    assert not (tmp_path / "out" / "_SUCCESS").exists()


def sales_texts(spark, path, rows):
    made = spark.range(rows).selectExpr(
        "concat('k', id) as ListingKey", "'Residential' as PropertyType", "if(id % 50 = 3, null, concat('2024-0', 1 + id % 4, '-11')) as CloseDate",
        "cast(400000 + 1000 * (id % 90) + if(id % 40 = 0, 90000000, 0) as string) as ClosePrice", "cast(410000 + id as string) as OriginalListPrice",
        "cast(900 + id % 70 as string) as LivingArea", "cast(id % 60 as string) as DaysOnMarket", "concat('county ', id % 3) as CountyOrParish", "'CA' as StateOrProvince",
    )
    made.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("rows", [0, 600])
def test_flagged_rows_dealt_in_slices_equal_those_of_one_pass(spark, tmp_path, monkeypatch, rows):
    raw = sales_texts(spark, f"{tmp_path}/raw", rows)
    seen = []
    plain = K.slices_for
    monkeypatch.setattr("tabkit.plans.pipeline.slices_for", lambda *a: seen.append(plain(*a)) or seen[-1])
    whole = run_pipeline(raw, SOLD, None, scratch_path(spark, "whole"))
    monkeypatch.setattr(K, "SLICE_BYTES", 1)
    sliced = run_pipeline(raw, SOLD, None, scratch_path(spark, "sliced"))
    assert seen == [1, K.MOST_SLICES]
    for stage in ("flagged", "final"):
        one, many = getattr(whole, stage), getattr(sliced, stage)
        assert one.dtypes == many.dtypes and sorted(map(str, one.collect())) == sorted(map(str, many.collect())), stage
    assert sliced.flagged.count() == rows and (not rows or 0 < sliced.final.count() < rows)
    # A cleaned stage that is not written has no files to slice.
    loose = run_pipeline(raw, SOLD, None, scratch_path(spark, "loose"), stages=("combined", "flagged"))
    assert loose.flagged.count() == rows and len(seen) == 2


def test_stages_are_packed_tightly(spark, tmp_path):
    raw = sales_texts(spark, f"{tmp_path}/raw", 50)
    run = run_pipeline(raw, SOLD, None, f"{tmp_path}/out")
    for stage in ("combined", "enriched", "cleaned", "flagged", "final"):
        files = [*(tmp_path / "out" / f"sold_{stage}").rglob("part-*.parquet")]
        assert files and all(".zstd." in f.name for f in files), stage
    assert run.final.count() > 0


def test_customers_are_joined_to_orders_before_sales(spark, tmp_path):
    ids = "array(1, 2, 2, 3, null)"
    for name, columns in {
        "lineitem": f"explode({ids}) as l_orderkey, 4 as l_partkey, 5 as l_linenumber",
        "part": "explode(array(4, 4, 6)) as p_partkey, 7 as p_size",
        "orders": f"explode({ids}) as o_orderkey, 8 as o_custkey",
        "customer": "explode(array(8, 8, 9, null)) as c_custkey, 1 as c_nationkey",
        "nation": "1 as n_nationkey, 'n' as n_name",
    }.items():
        spark.sql(f"select {columns}").write.parquet(f"{tmp_path}/{name}.parquet")
    for needs in (set(), {"part"}, {"orders"}, {"orders", "customer", "nation"}, set(V.JOINS)):
        plain = V.table(spark, str(tmp_path), "lineitem")
        for name, condition in V.JOINS.items():
            plain = plain.join(V.table(spark, str(tmp_path), name), F.expr(condition)) if name in needs else plain
        joined = V._joined(spark, str(tmp_path), needs)
        assert sorted(map(str, joined.select(sorted(plain.columns)).collect())) == sorted(map(str, plain.select(sorted(plain.columns)).collect())), needs
    joins = [line for line in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert "o_orderkey" in joins[0] and "l_orderkey" in joins[0]
