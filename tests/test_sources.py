import json

import pytest

from tabkit.operators import profile as P
from tabkit.operators.flags import in_region
from tabkit.plans.config import LISTED_EXPORT_COLUMNS, SOLD, SOLD_EXPORT_COLUMNS
from tabkit.plans.pipeline import pages_to_monthly
from tabkit.sources import monthly as M
from tabkit.sources import pages as J
from tabkit.sources import rates as R
from tabkit.sources import sinks as K
from tabkit.streaming.incremental import ingest_incremental, ingest_pages_incremental


def put(path, text, encoding="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "data"
    put(folder / "Sold202402.csv", "B,A,C\n2,one,x\n3,N/A,\n")
    put(folder / "Sold202401.csv", 'A,B\n"José",1\n"two\nlines ""q""",NaN\n')
    put(folder / "Sold_Cleaned.csv", "A,B\nderived,9\n")
    put(folder / "Sold2024.csv", "A,B\nderived,9\n")
    put(folder / "OldSold202401.csv", "A,B\nother,9\n")
    return folder


def test_discovery_takes_only_monthly_names_in_order(spark, landing):
    found = M.discover_monthly(spark, str(landing), "Sold")
    assert [f.month for f in found] == ["202401", "202402"]
    assert [f.path.rsplit("/", 1)[1] for f in found] == ["Sold202401.csv", "Sold202402.csv"]


def test_union_by_header_name_with_drift(spark, landing):
    files = M.discover_monthly(spark, str(landing), "Sold")
    df = M.read_monthly_csv(spark, files, source="source_file")
    got = sorted((tuple(r) for r in df.select("A", "B", "C", "source_file").collect()), key=str)
    assert got == sorted(
        [
            ("José", "1", None, "Sold202401.csv"),
            ('two\nlines "q"', None, None, "Sold202401.csv"),
            ("one", "2", "x", "Sold202402.csv"),
            (None, "3", None, "Sold202402.csv"),
        ],
        key=str,
    )
    counts = {r["source_file"]: r["rows"] for r in P.file_row_counts(df).collect()}
    assert counts == {"Sold202401.csv": 2, "Sold202402.csv": 2}


def test_only_files_with_open_quotes_are_read_whole(spark, landing):
    paths = [f.path for f in M.discover_monthly(spark, str(landing), "Sold")]
    looks = M.look_at_files(spark, paths)
    assert [p.rsplit("/", 1)[1] for p, look in looks.items() if look.open_quotes] == ["Sold202401.csv"]
    assert [look.header for look in looks.values()] == [("A", "B"), ("B", "A", "C")]


def test_repeated_headers(spark, tmp_path):
    put(tmp_path / "d" / "L202401.csv", "P,Q,P,Q,P\n1,2,3,4,5\n")
    files = M.discover_monthly(spark, str(tmp_path / "d"), "L")
    assert M.unique_names(["P", "Q", "P", "Q", "P"]) == ["P", "Q", "P.1", "Q.1", "P.2"]
    df = M.read_monthly_csv(spark, files)
    assert df.columns == ["P", "Q", "P.2"]
    assert tuple(df.first()) == ("1", "2", "5")
    assert M.read_monthly_csv(spark, files, drop_copies=False).columns == ["P", "Q", "P.1", "Q.1", "P.2"]


def test_no_input_is_an_error(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        M.read_monthly_csv(spark, M.discover_monthly(spark, str(tmp_path / "empty"), "Sold"))


def test_rate_file(spark, tmp_path):
    put(tmp_path / "rates.csv", "observation_date,SERIES\n2024-01-04,6.62\n2024-01-11,.\n2024-01-18,6.60\n")
    path = str(tmp_path / "rates.csv")
    assert [r[1] for r in R.read_rate_series(spark, path).coalesce(1).collect()] == [6.62, 6.6]
    assert R.rate_series_or_none(spark, path).count() == 2
    assert R.rate_series_or_none(spark, str(tmp_path / "absent.csv")) is None
    assert R.rate_series_or_none(spark, None) is None


def page(folder, name, *records):
    put(folder / name, json.dumps({"value": list(records), "@odata.nextLink": "next"}, indent=1), "utf-8")


@pytest.fixture
def pages(tmp_path):
    folder = tmp_path / "pages"

    def record(key, status, close, **more):
        return {"ListingKey": key, "MlsStatus": status, "CloseDate": close, **more}

    page(folder, "p1.json", record("a", "Closed", "2026-03-01", ClosePrice=500000), record("b", "Closed", "2026-04-01"))
    page(
        folder, "p2.json",
        record("c", "Closed", "2026-03-31T23:59:59Z", ClosePrice=None), record("d", "Active", "2026-03-05"),
        record("e", "Closed", "2026-02-28"), {"ListingKey": "f"},
    )
    return folder


def test_pages_to_rows_and_half_open_month(spark, pages):
    df = J.read_pages(spark, str(pages), SOLD_EXPORT_COLUMNS)
    assert df.columns == SOLD_EXPORT_COLUMNS and df.count() == 6
    assert {r["ListingKey"] for r in J.closed_month(df, "2026-03").collect()} == {"a", "c"}
    assert {r["ClosePrice"] for r in df.where("ListingKey in ('a', 'c')").collect()} == {"500000", None}


def test_export_column_lists():
    assert (len(SOLD_EXPORT_COLUMNS), len(set(SOLD_EXPORT_COLUMNS))) == (79, 79)
    assert (len(LISTED_EXPORT_COLUMNS), len(set(LISTED_EXPORT_COLUMNS))) == (70, 70)


def test_corrupt_page_fails(spark, pages):
    put(pages / "p3.json", '{"value": [ {"ListingKey": ')
    with pytest.raises(Exception):
        J.read_pages(spark, str(pages), ["ListingKey"]).collect()


def test_pages_to_monthly_export_and_back(spark, pages, tmp_path):
    out = str(tmp_path / "exports")
    path = pages_to_monthly(spark, str(pages), "2026-03", SOLD, out, "Sold")
    assert path.endswith("Sold202603.csv")
    files = M.discover_monthly(spark, out, "Sold")
    assert [f.month for f in files] == ["202603"]
    back = M.read_monthly_csv(spark, files)
    assert back.columns == SOLD_EXPORT_COLUMNS
    assert sorted((r["ListingKey"], r["ClosePrice"]) for r in back.collect()) == [("a", "500000"), ("c", None)]


def test_csv_stage_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a\n\"b\"", None, 1), (None, "2024-01", 2)], "t string, year_month string, n int")
    K.write_stage(df, str(tmp_path / "s"), "csv", period_columns=["year_month", "absent"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*.csv")))
    assert text.count("NaT") == 1
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "s"))
    assert {r["t"] for r in back.collect()} == {'a\n"b"', None}
    report = spark.createDataFrame([("x", 1, 50.0)], "column string, missing_count long, missing_pct double")
    K.write_report(report, str(tmp_path / "r"), index="column")
    (part,) = (tmp_path / "r").glob("part-*.csv")
    assert part.read_text().splitlines() == [",missing_count,missing_pct", "x,1,50.0"]


def test_partitioned_stage(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01"), (2, "2024-02")], "n int, yrmo string")
    K.write_stage(df, str(tmp_path / "s"), partition_by=["yrmo"])
    assert sorted(p.name for p in (tmp_path / "s").glob("yrmo=*")) == ["yrmo=2024-01", "yrmo=2024-02"]


def test_incremental_ingest_reads_only_new_files(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put(tmp_path / "in" / "Sold202401.csv", "A,B\n1,2\n")
    put(tmp_path / "in" / "Sold_Cleaned.csv", "A,B\n9,9\n")
    assert ingest_incremental(spark, landing, "Sold", out, checkpoint) == ["202401"]
    put(tmp_path / "in" / "Sold202402.csv", "B,A,C\n4,3,5\n")
    assert ingest_incremental(spark, landing, "Sold", out, checkpoint) == ["202402"]
    assert ingest_incremental(spark, landing, "Sold", out, checkpoint) == []
    table = spark.read.option("mergeSchema", True).parquet(out)
    assert sorted(tuple(r) for r in table.select("A", "B", "source_file").collect()) == [
        ("1", "2", "Sold202401.csv"), ("3", "4", "Sold202402.csv"),
    ]


def test_a_corrected_month_replaces_the_old_one(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def rows():
        return sorted((r["month"], r["A"]) for r in spark.read.option("mergeSchema", True).parquet(out).collect())

    put(tmp_path / "in" / "Sold202401.csv", "A\n1\n2\n")
    put(tmp_path / "in" / "Sold202402.csv" / "part-0.csv", "A\n3\n")
    put(tmp_path / "in" / "Sold202402.csv" / "part-1.csv", "A\n4\n")
    ingest_incremental(spark, landing, "Sold", out, checkpoint)
    put(tmp_path / "in" / "Sold202401.csv", "B,A\nx,1\ny,2\nz,5\n")
    assert ingest_incremental(spark, landing, "Sold", out, checkpoint) == ["202401"]
    assert rows() == [(202401, "1"), (202401, "2"), (202401, "5"), (202402, "3"), (202402, "4")]
    # A part that is gone or new, and a month that lost all its rows.
    (tmp_path / "in" / "Sold202402.csv" / "part-1.csv").unlink()
    put(tmp_path / "in" / "Sold202401.csv", "A\n")
    assert ingest_incremental(spark, landing, "Sold", out, checkpoint) == ["202401", "202402"]
    assert rows() == [(202402, "3")]
    assert ingest_incremental(spark, landing, "Sold", out, checkpoint) == []


def test_a_failed_run_is_made_good(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put(tmp_path / "in" / "Sold202401.csv", "A\n1\n")
    put(tmp_path / "in" / "Sold202402.csv", "A\n2,3\n")
    with pytest.raises(Exception, match="does not fit"):
        ingest_incremental(spark, landing, "Sold", out, checkpoint)
    put(tmp_path / "in" / "Sold202402.csv", "A\n2\n")
    assert ingest_incremental(spark, landing, "Sold", out, checkpoint) == ["202402"]
    assert sorted(r["A"] for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_records_that_do_not_fit(spark, tmp_path):
    put(tmp_path / "S202401.csv", 'A,B\n1,2\n4,5,6\n3\n\n7,"x,""y"\n')
    put(tmp_path / "S202402.csv", 'A,B,C\n1,"two\nlines",2\n"9\n9",8\n')
    paths = [str(tmp_path / n) for n in ("S202401.csv", "S202402.csv")]
    for path in paths:
        with pytest.raises(Exception, match="does not fit its"):
            M.read_monthly_csv(spark, [path]).count()
    rejects = str(tmp_path / "rejects")
    read = M.read_monthly_csv(spark, paths, rejects=rejects)
    assert {tuple(r) for r in read.select("A", "B", "C").collect()} == {("1", "2", None), ("7", 'x,"y', None), ("1", "two\nlines", "2")}
    found = {(r["file"].rsplit("/", 1)[1], r["cells"], r["columns"], r["record"]) for r in spark.read.parquet(rejects).collect()}
    assert found == {("S202401.csv", 3, 2, "4,5,6"), ("S202401.csv", 1, 2, "3"), ("S202402.csv", 2, 3, '"9\n9",8')}
    filled = M.read_monthly_csv(spark, paths, rejects=rejects, short="fill")
    assert filled.count() == 5 and spark.read.parquet(rejects).count() == 1
    with pytest.raises(Exception, match="4,5,6"):
        M.read_monthly_csv(spark, paths, short="fill").collect()
    with pytest.raises(ValueError):
        M.read_monthly_csv(spark, paths, short="drop")


def test_headers_are_records_in_the_files_encoding(spark, tmp_path):
    put(tmp_path / "S202401.csv", "Prénom,Ville\nJosé,Évry\n")
    put(tmp_path / "S202402.csv", 'Ville,"Prénom"\r\nNîmes,Zoé\r\n')
    put(tmp_path / "S202403.csv", '"A\n""B""",C,D\n1,2,3\n')
    paths = [str(tmp_path / f"S20240{k}.csv") for k in (1, 2, 3)]
    read = M.read_monthly_csv(spark, paths[:2])
    assert {tuple(r) for r in read.select("Prénom", "Ville").collect()} == {("José", "Évry"), ("Zoé", "Nîmes")}
    broken = M.read_monthly_csv(spark, paths[2:])
    assert broken.columns == ['A\n"B"', "C", "D"] and tuple(broken.first()) == ("1", "2", "3")
    put(tmp_path / "S202404.csv", "Größe\n1\n", "utf-8")
    assert M.read_monthly_csv(spark, [str(tmp_path / "S202404.csv")], encoding="UTF-8").columns == ["Größe"]
    put(tmp_path / "S202405.csv", '"A,B\n1,2\n')
    with pytest.raises(ValueError, match="leaves a quote open"):
        M.read_monthly_csv(spark, [str(tmp_path / "S202405.csv")])


def test_names_that_differ_in_case_or_clash(spark, tmp_path):
    assert M.unique_names(["A", "A", "A.1"]) == ["A", "A.2", "A.1"]
    assert len({n.lower() for n in M.unique_names(["A", "a", "a", "A", "A_2", "a.1"])}) == 6
    put(tmp_path / "c[1]" / "S202401.csv", "A,a,A,A.1\n1,2,3,4\n")
    files = M.discover_monthly(spark, str(tmp_path / "c[1]"), "S")
    assert len(files) == 1
    read = M.read_monthly_csv(spark, files, drop_copies=False)
    assert read.columns == ["A", "a_2", "A.2", "A.1"] and tuple(read.first()) == ("1", "2", "3", "4")


def test_types_from_all_values(spark, tmp_path):
    put(tmp_path / "S202401.csv", "key,n,x,none,big,mixed\na1,1,1.5,,99999999999999999999,1\nb2,-2,3,,1,x\nc3,,1e3,,,\n")
    read = M.read_monthly_csv(spark, [str(tmp_path / "S202401.csv")])
    assert P.inferred_types(read) == {"key": "string", "n": "bigint", "x": "double", "none": "double", "big": "double", "mixed": "string"}
    typed = P.with_inferred_types(read)
    assert P.text_columns(typed) == ["key", "mixed"] and P.text_columns(read) == read.columns
    assert tuple(typed.where("key = 'b2'").first()) == ("b2", -2, 3.0, None, 1.0, "x")
    assert P.inferred_types(typed, ["n"]) == {}


def test_a_chain_of_pages_that_breaks_off(spark, tmp_path):
    def land(folder, name, own, following, *keys):
        page = {"value": [{"ListingKey": k} for k in keys], "@odata.id": own, "@odata.nextLink": following}
        put(tmp_path / folder / name, json.dumps({k: v for k, v in page.items() if v is not None}), "utf-8")

    land("p", "1.json", "u/1", "u/2", "a")
    land("p", "2.json", "u/2", "u/3", "b")
    with pytest.raises(ValueError, match="u/3"):
        J.read_pages(spark, str(tmp_path / "p"), ["ListingKey"])
    assert J.read_pages(spark, str(tmp_path / "p"), ["ListingKey"], complete=False).count() == 2
    land("p", "3.json", "u/3", None, "c")
    assert J.read_pages(spark, str(tmp_path / "p"), ["ListingKey"]).count() == 3
    # Without own addresses, a chain in which every page goes on.
    land("q", "1.json", None, "u/2", "a")
    land("q", "2.json", None, "u/3", "b")
    with pytest.raises(ValueError, match="did not land"):
        J.read_pages(spark, str(tmp_path / "q"), ["ListingKey"])
    land("q", "3.json", None, None, "c")
    assert J.read_pages(spark, str(tmp_path / "q"), ["ListingKey"]).count() == 3


def test_incremental_pages(spark, pages, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    ingest_pages_incremental(spark, str(pages), ["ListingKey"], out, checkpoint)
    page(pages, "p9.json", {"ListingKey": "z"})
    ingest_pages_incremental(spark, str(pages), ["ListingKey"], out, checkpoint)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d", "e", "f", "z"]


@pytest.mark.parametrize("name", ["my data", "100%", "a+b", "Größe é", "x#y"])
def test_paths_that_urls_encode(spark, tmp_path, name):
    put(tmp_path / name / "Sold202401.csv", 'A,B\n"two\nlines",1\n')
    put(tmp_path / name / "Sold202402.csv", "A,B\nplain,2\n")
    files = M.discover_monthly(spark, str(tmp_path / name), "Sold")
    got = M.read_monthly_csv(spark, files, source="source_file").collect()
    assert {tuple(r) for r in got} == {("two\nlines", "1", "Sold202401.csv"), ("plain", "2", "Sold202402.csv")}


def test_copies_in_deeper_folders_are_not_read(spark, tmp_path):
    put(tmp_path / "Sold202401.csv", "A\n1\n")
    put(tmp_path / "backup" / "Sold202401.csv", "A\n1\n")
    put(tmp_path / "Sold202402.csv" / "part-0.csv", "A\n2\n")
    put(tmp_path / "Sold202402.csv" / "old" / "part-0.csv", "A\n3\n")
    files = M.discover_monthly(spark, str(tmp_path), "Sold")
    assert [f.month for f in files] == ["202401", "202402"]
    assert {r["A"] for r in M.read_monthly_csv(spark, files[:1]).collect()} == {"1"}


def test_prefix_with_pattern_signs(spark, tmp_path):
    put(tmp_path / "S[1]*202401.csv", "A\n1\n")
    put(tmp_path / "S1x202401.csv", "A\n2\n")
    assert [f.path.rsplit("/", 1)[1] for f in M.discover_monthly(spark, str(tmp_path), "S[1]*")] == ["S[1]*202401.csv"]


def test_error_page_fails_and_empty_page_does_not(spark, pages):
    page(pages, "p4.json")
    assert J.read_pages(spark, str(pages), ["ListingKey"]).count() == 6
    put(pages / "p5.json", '{"error": "over quota"}')
    with pytest.raises(Exception, match="without a value array"):
        J.read_pages(spark, str(pages), ["ListingKey"]).collect()


def test_csv_keeps_cells_and_the_rows_that_depend_on_them(spark, tmp_path):
    rows = [("CA", "José"), (" CA ", "two\nlines, \"quoted\""), ("\t", " x "), (None, "back\\slash\\"), ("NV", None)]
    df = spark.createDataFrame([(s, n, 34.0, -118.0) for s, n in rows], "StateOrProvince string, n string, Latitude double, Longitude double")
    for number, write in enumerate(
        (
            lambda path: K.write_stage(df, path, "csv"),
            lambda path: K.write_month(df, str(tmp_path), "M", "2024-02", df.columns),
        )
    ):
        path = f"{tmp_path}/M20240{number + 1}.csv"
        write(path)
        back = M.read_monthly_csv(spark, [path])
        assert {tuple(r) for r in back.select("StateOrProvince", "n").collect()} == set(rows)
        assert in_region(back).count() == in_region(df).count()


def test_characters_that_the_encoding_lacks_fail(spark, tmp_path):
    df = spark.createDataFrame([("Łukasz",)], "n string")
    with pytest.raises(Exception, match="not in ISO-8859-1"):
        K.write_month(df, str(tmp_path), "M", "2024-01", ["n"])
    path = K.write_month(df, str(tmp_path), "M", "2024-02", ["n"], encoding="UTF-8")
    assert M.read_monthly_csv(spark, [path], encoding="UTF-8").first()["n"] == "Łukasz"


def test_month_export_feeds_the_stream(spark, pages, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    pages_to_monthly(spark, str(pages), "2026-03", SOLD, landing, "Sold")
    ingest_incremental(spark, landing, "Sold", out, checkpoint)
    assert {r["ListingKey"] for r in spark.read.parquet(out).collect()} == {"a", "c"}


def test_a_reader_of_one_month_opens_one_folder(spark, tmp_path):
    df = spark.createDataFrame([(k, f"2024-0{1 + k % 3}") for k in range(30)], "n int, yrmo string")
    table = K.checkpoint_stage(spark, df, str(tmp_path / "s"), partition_by=["yrmo"])
    plan = table.where("yrmo = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yrmo" in plan and table.where("yrmo = '2024-02'").count() == 10
