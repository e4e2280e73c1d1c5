"""Stage tables, reports and monthly exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffles_released
from .monthly import CSV_ENCODING

#: A slice has so many bytes of the table it is made from, but a table is never dealt in more than MOST_SLICES: each leaves a file in every folder.
SLICE_BYTES = 64 << 20
MOST_SLICES = 8


def _as_csv(df: DataFrame, encoding: str):
    """A writer whose cells read back as they are: blanks kept, quotes doubled.

    A character that the encoding lacks fails the job instead of becoming a question mark.
    """
    if encoding.upper() in ("ISO-8859-1", "LATIN1"):
        checked = []
        for name, kind in df.dtypes:
            cell = F.col(f"`{name}`")
            if kind == "string":
                error = F.raise_error(F.concat(F.lit(f"not in {encoding}, column {name}: "), cell))
                cell = F.when(cell.rlike(r"[^\x00-\xFF]"), error).otherwise(cell)
            checked.append(cell.alias(name))
        df = df.select(*checked)
    options = {"header": True, "escape": '"', "encoding": encoding}
    return df.write.mode("overwrite").options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def slices_for(spark: SparkSession, table: str) -> int:
    """In how many slices rows made from a written table are dealt by folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return min(MOST_SLICES, -(-size // SLICE_BYTES)) or 1


def _slice(df: DataFrame, i: int, slices: int) -> DataFrame:
    """Rows made from every ``slices``-th file of a table. Spark evaluates the condition by file, and opens no other files."""
    number = "try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) as bigint)"
    return df.where(f"pmod(coalesce({number}, xxhash64(_metadata.file_name)), {slices}) = {i}")


def write_stage(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    period_columns: Sequence[str] = (),
    encoding: str = CSV_ENCODING,
    dealt: bool = False,
    slices: int = 1,
) -> None:
    """Write a stage. Parquet keeps types; ``fmt='csv'`` writes what ``read_monthly_csv`` reads back in the same encoding.

    ``period_columns`` are month keys whose null is written as ``NaT`` in CSV. With
    ``partition_by`` rows are dealt by folder in one pass over the input; adaptive execution lets many tasks write a folder with many rows.
    ``dealt`` says that the rows come from a table laid out by the same folders: its files are read and written without a shuffle.
    ``slices`` says that the rows are made row by row from one written table: they are dealt in so many passes, each over its share of
    the table's files, and the shuffle of one is gone before the next begins. The table is marked as whole by the last one.
    """
    if fmt == "csv":
        present = [c for c in period_columns if c in df.columns]
        df = df.fillna("NaT", subset=present) if present else df
    if "_metadata" in map(str.lower, df.columns):
        slices = 1  # a column of that name hides the names of the files
    for i in range(slices):
        rows = _slice(df, i, slices) if slices > 1 else df
        if partition_by and not dealt:
            rows = rows.hint("rebalance", *[F.col(c) for c in partition_by])
        # Tables of texts take about 0.7 of the room that Spark's own choice leaves them.
        out = _as_csv(rows, encoding) if fmt == "csv" else rows.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            out = out.partitionBy(*partition_by)
        if slices > 1:
            out = out.mode("append") if i else out.option("partitionOverwriteMode", "static")
            out = out.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(i == slices - 1).lower())
        with shuffles_released(df.sparkSession):
            out.format(fmt).save(path)


def checkpoint_stage(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    dealt: bool = False,
    slices: int = 1,
    **options,
) -> DataFrame:
    """Write a stage and go on from the written table, so later stages do not recompute it.

    ``partition_by`` are text columns; a reader of one value then opens one folder. A CSV copy is for
    exchange only: types would be lost on the way back.
    """
    write_stage(df, path, "parquet", partition_by, dealt=dealt, slices=slices)
    if fmt != "parquet":
        write_stage(spark.read.schema(df.schema).parquet(path), f"{path}.{fmt}", fmt, **options)
    return spark.read.schema(df.schema).parquet(path)


class Counts:
    """Aggregates of a frame that come about while a stage made from it is written, without a scan of their own.

    Only for stages written without a shuffle behind the frame: a task that runs again after a lost executor would
    count twice there, whereas a written part counts once.
    """

    def __init__(self, **counted: Column):
        self.counted = counted
        self._seen = Observation()

    def of(self, df: DataFrame) -> DataFrame:
        return df.observe(self._seen, *[c.alias(name) for name, c in self.counted.items()])

    def row(self, spark: SparkSession) -> DataFrame:
        """One row of the aggregates, once the stage is written."""
        found = self._seen.get
        return spark.createDataFrame([tuple(found[name] for name in self.counted)], T.StructType([T.StructField(name, T.LongType()) for name in self.counted]))


def write_report(df: DataFrame, path: str, index: str | None = None) -> None:
    """A report as one CSV file with header; ``index`` is the column whose header stays blank."""
    named = df.withColumnRenamed(index, "") if index else df
    with shuffles_released(df.sparkSession):
        _as_csv(named.coalesce(1), "UTF-8").option("emptyValue", "").csv(path)


def write_month(
    df: DataFrame, folder: str, prefix: str, month: str, columns: Sequence[str], encoding: str = CSV_ENCODING
) -> str:
    """One month of an export as ``<prefix>YYYYMM.csv`` (a folder of part files), nulls as empty cells."""
    path = f"{folder.rstrip('/')}/{prefix}{month.replace('-', '')}.csv"
    existing = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    _as_csv(df.select(*existing), encoding).csv(path)
    return path
