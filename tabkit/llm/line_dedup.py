"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only.

A run holds, per line hash, in how many documents of its batches the line occurs and the largest of
their ids; it is bucketed and sorted by the hash, so that a new batch meets it by a merge join and the
run isn't shuffled. A batch leaves out the lines a run has settled already (found in enough documents, up to
an id at least as large), for they can no longer change a decision. When a level has ``fanout`` runs,
they are merged into one of the next level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Scratch

#: Stripped at both ends of a line: space and 09 to 0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines in at least so many documents may be looked up without a shuffle: the ``HOT_LINES`` most frequent ones, which are broadcast (16 bytes
#: of hash and an id each).
HOT_DOCS, HOT_LINES = 256, 100_000
#: Stands for a null document id; rows without an id count as one document.
NO_ID = -(2**63)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` does the same on plain ASCII and is faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    """The lines of a text; one empty line for null and for the empty text."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs of (hash, n_docs, top_id)."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 2, buckets: int = 16):
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, buckets
        self.scratch = Scratch(spark, "lines")
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = run.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash")
        writer.option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.remove(f"{self.scratch.root}/{name}")

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs merged pair by pair; both sides are bucketed and sorted alike."""
        merged = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select("hash", F.col("n_docs").alias("__n"), F.col("top_id").alias("__top"))
            both = merged.join(other.hint("merge"), "hash", "full_outer")
            n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("__n", F.lit(0))
            merged = both.select("hash", n_docs.alias("n_docs"), F.greatest("top_id", "__top").alias("top_id"))
        return merged

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (hash, id). No document may be spread over two batches."""
        batch = keys.groupBy("hash", "id").agg(F.count(F.lit(1)).alias("__lines"))
        batch = batch.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("top_id"))
        for name in sum(self.levels, []):
            run = self.spark.table(name).where(F.col("n_docs") >= self.min_docs)
            run = run.select(F.col("hash").alias("__hash"), F.col("top_id").alias("__top"))
            settled = (F.col("hash") == F.col("__hash")) & (F.col("top_id") <= F.col("__top"))
            batch = batch.join(run.hint("merge"), settled, "left_anti")
        self._write(batch, 0)
        self.compact()

    def compact(self, whole: bool = False) -> None:
        """Merge every level that has ``fanout`` runs; with ``whole``, all runs into one."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                names, self.levels[level] = self.levels[level], []
                self._write(self._merged(names), level + 1)
                for name in names:
                    self._forget(name)
            level += 1
        names = sum(self.levels, [])
        if whole and len(names) > 1:
            self.levels = []
            self._write(self._merged(names), level)
            for name in names:
                self._forget(name)

    def settled(self) -> DataFrame:
        """(hash, n_docs, top_id) of the lines found in at least ``min_docs`` documents. Ends the runs: the last one leaves the catalog, its files stay."""
        self.compact(whole=True)
        (name,) = sum(self.levels, [])
        found = self.spark.table(name).where(F.col("n_docs") >= self.min_docs).select("hash", "n_docs", "top_id")
        self.spark.sql(f"DROP TABLE {name}")
        self.levels = []
        return found


def hot_from(settled: DataFrame, hot_docs: int = HOT_DOCS, hot_lines: int = HOT_LINES) -> int | None:
    """The least power of two times ``hot_docs`` such that at most ``hot_lines`` lines are in as many documents; None if no line is in ``hot_docs``.

    More than ``hot_lines`` lines are in half as many, so any line in fewer holds less than 2 / ``hot_lines`` of what all lines
    hold. One row per power of two comes to the driver.
    """
    power = F.floor(F.log2(F.col("n_docs") / F.lit(hot_docs)) + F.lit(1e-9)).cast("int")
    rows = settled.where(F.col("n_docs") >= hot_docs).groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("lines")).orderBy(F.desc("power")).collect()
    if not rows:
        return None
    least, lines = hot_docs << (rows[0].power + 1), 0
    for row in rows:
        lines += row.lines
        if lines > hot_lines:
            break
        least = hot_docs << row.power
    return least


def lost_lines(lines: DataFrame, settled: DataFrame, hot_docs: int = HOT_DOCS, hot_lines: int = HOT_LINES) -> DataFrame:
    """The rows of ``lines`` whose document isn't the largest that holds their settled line.

    Occurrences of very frequent lines meet them where they are read; all others meet the bucketed run in a merge join.
    """
    lost = F.col("id") != F.col("top_id")
    least = hot_from(settled, hot_docs, hot_lines)
    if least is None:
        return lines.join(settled, "hash").where(lost).select(lines.columns)
    hot = F.broadcast(settled.where(F.col("n_docs") >= least).select("hash", "top_id"))
    rest = lines.join(hot, "hash", "left_anti").join(settled.where(F.col("n_docs") < least), "hash")
    return lines.join(hot, "hash").where(lost).select(lines.columns).unionByName(rest.where(lost).select(lines.columns))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    min_chars: int = 20,
    batches: int = 4,
    fanout: int = 2,
    buckets: int | None = None,
) -> DataFrame:
    """Drop lines that many documents share, but for the document with the largest id.

    Every row of ``docs`` comes back with all its columns, the text replaced by the kept lines, and
    ``n_lines`` (before dropping) and ``n_dropped``. A line's key is the line stripped of blanks at both ends with A-Z
    lower-cased; keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents go. Documents are added batch by batch, largest ids first; the result doesn't depend on the batches.

    Null and empty text: one empty line, text ''. A text may lose all lines. Rows with the
    same id are one document; rows without an id are together one document below all ids.
    Repeated rows stay. An empty table gives an empty result. Columns of ``docs`` named ``n_lines`` or
    ``n_dropped`` are replaced. Lines are compared by 128-bit hash. ``buckets`` of a run: as many as shuffle partitions, if not given.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LineRuns(spark, min_docs, fanout, buckets)
    own = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    names = own.columns
    mark = "__"
    while any(c.lower().startswith(mark) for c in names):
        mark += "_"
    own_id, own_row, own_gone, own_lines = (mark + n for n in ("id", "row", "gone", "lines"))
    own = own.withColumns({own_id: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), own_row: F.xxhash64(F.coalesce(text_col, F.lit("")))})

    if batches > 1:
        steps = [i / batches for i in range(1, batches)]
        cuts = own.agg(F.percentile_approx(own_id, steps, 1000)).first()[0] or []
    else:
        cuts = []
    batch = sum([(F.col(own_id) <= F.lit(cut)).cast("int") for cut in cuts], F.lit(0))
    lines = own.select(F.col(own_id).alias("id"), F.col(own_row).alias("row"), batch.alias("batch"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    lines = lines.select("batch", F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash"), "id", "row", "pos")
    lines = runs.scratch.keep(lines, "keys", ("batch",))
    for number in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == number).select("hash", "id"))

    gone = lost_lines(lines, runs.settled())
    gone = gone.groupBy(F.col("id").alias(own_id), F.col("row").alias(own_row)).agg(F.collect_set("pos").alias(own_gone))
    out = own.join(gone, [own_id, own_row], "left").withColumn(own_lines, lines_of(F.col(text_col)))
    all_lines, lost = F.col(own_lines), F.col(own_gone)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), lost), lambda i: F.get(all_lines, i))
    text = F.when(lost.isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(lost.isNull(), F.lit(0)).otherwise(F.size(lost)).cast("long")
    columns = [F.col(f"`{c}`") if c != text_col else text.alias(text_col) for c in names]
    return out.select(*columns, F.size(all_lines).cast("long").alias("n_lines"), dropped.alias("n_dropped"))
