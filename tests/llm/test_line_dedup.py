import random
import re

from pyspark.sql import functions as F

from tabkit.llm.line_dedup import LineRuns, dedup_lines, hot_from, lost_lines

TRIM = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = TRIM.sub("", line).translate(LOWER)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(-(2**63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            held = holders.get(TRIM.sub("", line).translate(LOWER), ())
            if len(held) < 3 or max(held) == (-(2**63) if doc is None else doc):
                kept.append(line)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def check(docs, rows, **options):
    got = dedup_lines(docs, **options).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_against_brute_force(spark, docs_of, edge_rows):
    random.seed(1)
    pool = [f"A common line of text number {k} É" for k in range(12)] + ["short", "", "  ", "\x0bPadded line that is long enough\x0c "]
    rows = [(k, "\n".join(random.choice(pool) + random.choice(["", " ", "\t"]) for _ in range(random.randint(0, 8)))) for k in range(60)]
    rows += [(7, rows[7][1]), (7, "A common line of text number 1 É"), (None, rows[3][1]), (None, rows[4][1]), *edge_rows]
    for batches in (1, 4):
        check(docs_of(rows, extra=True), rows, batches=batches, buckets=4)


def test_all_lines_may_go_and_columns_stay(docs_of):
    line = "the very same line in all of them"
    out = dedup_lines(docs_of([(k, line) for k in range(4)], extra=True), buckets=2)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(0, ""), (1, ""), (2, ""), (3, line)}
    assert "set" in out.columns and dict(out.dtypes)["n_lines"] == "bigint"


def test_empty_table(docs_of):
    assert dedup_lines(docs_of([]), buckets=2).count() == 0


def test_runs_are_levelled_and_skip_settled_lines(spark):
    runs = LineRuns(spark, min_docs=2, fanout=2, buckets=2)
    keys = lambda lo, hi: spark.range(lo, hi).select(F.lit("x").alias("hash"), F.col("id"))
    runs.add(keys(10, 14))
    assert [len(level) for level in runs.levels] == [1]
    runs.add(keys(5, 9))  # settled at larger ids: adds nothing
    assert [len(level) for level in runs.levels] == [0, 1]
    assert [tuple(r) for r in spark.table(runs.levels[1][0]).collect()] == [("x", 4, 13)]
    runs.add(keys(20, 21))  # a larger id than the settled one still counts
    assert [(r["hash"], r["top_id"]) for r in runs.settled().collect()] == [("x", 20)]


def test_frequent_lines_take_another_way_to_the_same_rows(spark):
    random.seed(3)
    lines = [(f"line{min(int(random.expovariate(0.2)), 40)}", doc, 0, pos) for doc in range(300) for pos in range(6)]
    docs = {}
    for line, doc, _, _ in lines:
        docs.setdefault(line, set()).add(doc)
    settled = spark.createDataFrame([(line, len(d), max(d)) for line, d in docs.items() if len(d) >= 3], "hash string, n_docs long, top_id long")
    rows = spark.createDataFrame(lines, "hash string, id long, row long, pos int")
    want = sorted(r for r in lines if len(docs[r[0]]) >= 3 and r[1] != max(docs[r[0]]))
    for hot_docs, hot_lines in ((10**6, 10), (4, 10**6), (4, 5), (16, 0)):
        assert sorted(tuple(r) for r in lost_lines(rows, settled, hot_docs, hot_lines).collect()) == want
    counts = sorted((len(d) for d in docs.values()), reverse=True)
    assert hot_from(settled, 10**6) is None and hot_from(settled, 4, 10**6) <= 8
    for hot_lines in (0, 5, 20):
        assert sum(n >= hot_from(settled, 4, hot_lines) for n in counts) <= hot_lines
        assert sum(n >= hot_from(settled, 4, hot_lines) // 2 for n in counts) > hot_lines


def test_columns_with_underscores_stay_and_the_catalog_is_left_clean(spark, docs_of):
    line = "the very same line in all of them"
    docs = docs_of([(k, line) for k in range(4)]).selectExpr("*", "'a' as __id", "'b' as __row", "'c' as ___gone", "'d' as `__lines`")
    before = {t.name for t in spark.catalog.listTables()}
    out = dedup_lines(docs, buckets=2)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = out.select("doc_id", "text", "__id", "__row", "___gone", "__lines").collect()
    assert {tuple(r) for r in got} == {(k, line if k == 3 else "", "a", "b", "c", "d") for k in range(4)}
