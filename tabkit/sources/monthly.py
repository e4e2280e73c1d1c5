"""Monthly CSV exports whose headers drift between months and may repeat a name."""

from __future__ import annotations

import csv
import io
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import normalise_tokens


@dataclass(frozen=True, order=True)
class MonthlyFile:
    month: str
    path: str


#: Exports are written and read in this encoding unless told otherwise.
CSV_ENCODING = "ISO-8859-1"


def _glob_name(name: str) -> str:
    """A name with the signs that mean something in a path pattern escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


def discover_monthly(spark: SparkSession, folder: str, prefix: str) -> list[MonthlyFile]:
    """The exports ``<prefix>YYYYMM.csv`` directly in the folder, in month order; each a file or a folder of part files.

    Any other name, such as a derived ``<prefix>_Cleaned.csv``, is ignored, and so are copies in deeper
    folders: reading results or copies back as input would count rows twice. Only paths are listed, no content is read. Folder and prefix are
    names, not patterns.
    """
    names = f"{_glob_name(folder.rstrip('/'))}/{_glob_name(prefix)}{'[0-9]' * 6}.csv"
    try:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(names).select("path")
    except Exception as error:  # the class differs between classic and Connect sessions
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []
    pattern = rf"^(.*/{re.escape(prefix)}([0-9]{{6}})\.csv)(/part-[^/]+)?$"
    found = listing.select(
        F.regexp_extract("path", pattern, 2).alias("month"), F.regexp_extract("path", pattern, 1).alias("file")
    )
    return sorted(MonthlyFile(r["month"], r["file"]) for r in found.where("file <> ''").distinct().collect())


def plain_path(path: Column | str = "_metadata.file_path") -> Column:
    """The path of a row's file as it was given: the metadata column holds it with signs encoded as in a URL."""
    return F.url_decode(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("+"), F.lit("%2B")))


def path_end() -> Column:
    """The last two names of a row's path as they were given. Decoding whole paths, and searching them, takes longer than reading short records."""
    return plain_path(F.substring_index("_metadata.file_path", "/", -2))


def _bare(path: str) -> str:
    """Without the scheme of local files, which is written in several ways."""
    return re.sub(r"^file:/*", "/", path).rstrip("/")


@dataclass(frozen=True)
class FileLook:
    """The header cells of an export, and whether a cell of it may span lines."""

    header: tuple[str, ...]
    open_quotes: bool


def _header_cells(record: bytes, encoding: str) -> tuple[str, ...]:
    text = record.decode(encoding).lstrip("\ufeff")
    return tuple(next(csv.reader(io.StringIO(text, newline="")), ()))


def _openings(lines: DataFrame) -> DataFrame:
    """Per file the number of its first line, and whether it has an odd line.

    Numbers alone are aggregated over all lines, by hashing: with lines among them, each task would sort all of its lines.
    """
    return lines.groupBy("path").agg(F.min(F.when(F.col("start") == 0, F.col("id"))).alias("upto"), F.max("odd").alias("odd"))


def look_at_files(spark: SparkSession, paths: Sequence[str], encoding: str = CSV_ENCODING) -> dict[str, FileLook]:
    """Header cells of every file, and whether some line has an odd number of quotes. Empty files are left out.

    Two jobs over all files: one finds odd lines and where each file begins, one fetches the first lines. Files without an odd line can be split
    between tasks. One row per file comes to the driver. The header is the first record, decoded from the file's bytes: where its first line leaves a quote open, it goes on up to the next line with an odd number of
    quotes, which another job over those files alone fetches. Line breaks inside header cells read as line feeds. The encoding
    must write quotes and line breaks as ASCII does.
    """
    wanted = {_bare(p): p for p in paths}
    # Counted in bytes: the reader hands on a line as it is, whatever its encoding.
    odd = F.expr("octet_length(value) % 2 <> octet_length(replace(value, '\"', '')) % 2")
    lines = spark.read.text([_glob_name(p) for p in paths]).select(
        F.col("_metadata.file_path").alias("path"), plain_path().alias("file"), F.col("value").cast("binary").alias("line"), odd.alias("odd"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"),
    )
    seen = _openings(lines).collect()
    if not seen:
        return {}
    heads = lines.where("start = 0").select("path", "file", "line", F.col("odd").alias("goes_on"), "id")

    def first_lines(heads: DataFrame) -> DataFrame:
        return heads.groupBy("path").agg(*[F.min_by(c, "id").alias(c) for c in ("file", "line", "goes_on")])

    upto = F.broadcast(spark.createDataFrame([(r["path"], r["upto"]) for r in seen], "path string, upto long"))
    found_first = {r["path"]: r for r in first_lines(heads.join(upto, "path").where("id <= upto")).collect()}
    # Lines are numbered anew by every job; where tasks were cut otherwise, a file may have none up to its number.
    unseen = [r["path"] for r in seen if r["path"] not in found_first]
    if unseen:
        found_first |= {r["path"]: r for r in first_lines(heads.where(F.col("path").isin(unseen))).collect()}
    rows = sorted(({**found_first[r["path"]].asDict(), "odd": r["odd"]} for r in seen), key=lambda r: r["file"])
    first = {r["file"]: bytes(r["line"]) for r in rows}
    longer = [r["file"] for r in rows if r["goes_on"]]
    if longer:
        place = F.expr("cast(start as decimal(19, 0)) * 10000000000000000000BD + id")
        own = lines.where(F.col("file").isin(longer)).withColumn("place", place)
        starts = own.groupBy("file").agg(F.min("place").alias("first"))
        closing = own.where("odd").join(F.broadcast(starts), "file").where("place > first").groupBy("file").agg(F.min("place").alias("end"))
        for row in starts.join(closing, "file", "left").where("end is null").select("file").collect():
            raise ValueError(f"the header of {row['file']} leaves a quote open")
        records = own.join(F.broadcast(closing), "file").where("place <= end")
        for row in records.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines")).collect():
            first[row["file"]] = b"\n".join(bytes(part["line"]) for part in row["lines"])
    found: dict[str, FileLook] = {}
    for row in rows:
        file = _bare(row["file"])
        path = wanted.get(file) or wanted.get(file.rsplit("/", 1)[0])
        if path is None:
            raise ValueError(f"a file that was not asked for: {row['file']}")
        before = found.get(path)
        header = before.header if before else _header_cells(first[row["file"]], encoding)
        found[path] = FileLook(header, row["odd"] or bool(before and before.open_quotes))
    return found


def unique_names(header: Sequence[str]) -> list[str]:
    """Repeated names get ``.1``, ``.2`` and so on, the first number that no cell of the header has; the first copy keeps its name.

    Columns are told apart without regard to case, so a name that differs from an earlier one in case only gets ``_2``, ``_3``
    and so on: it is another column, not a copy that ``drop_second_copies`` would drop.
    """
    copies: dict[str, int] = defaultdict(int)
    taken: set[str] = set()
    cells = {cell.lower() for cell in header}
    names = []
    for cell in header:
        name, joint, number = cell, ".", copies[cell]
        if not number and cell.lower() in taken:
            joint, number = "_", 2
        while number and (f"{cell}{joint}{number}".lower() in cells or f"{cell}{joint}{number}".lower() in taken):
            number += 1
        if number:
            name = f"{cell}{joint}{number}"
        copies[cell] = number + 1 if joint == "." else 1
        taken.add(name.lower())
        names.append(name)
    return names


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def drop_second_copies(df: DataFrame) -> DataFrame:
    """Drop every column whose name ends in ``.1``. A third copy (``.2``) stays."""
    return df.select(*[F.col(quoted(c)) for c in df.columns if not c.endswith(".1")])


#: Columns of a record that does not fit its header.
REJECTED = ["file", "cells", "columns", "record"]
_RECORD = "__record"


def _read_group(spark: SparkSession, header: Sequence[str], paths: Sequence[str], multiline: bool, encoding: str) -> DataFrame:
    """All records of files with one header, those that don't fit it whole in ``__record``, the file's path in ``__file``, and the end of it in ``__end``."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*unique_names(header), _RECORD]])
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multiline)
        .option("escape", '"')  # without it a doubled quote before a line break splits the row
        .option("columnNameOfCorruptRecord", _RECORD)
        .option("columnPruning", False)  # else a record's cells are only counted as far as columns are used
        .csv([_glob_name(p) for p in paths])
    )
    # Nothing of the first column, named here because Spark refuses to read the record alone.
    nothing = F.substring(F.coalesce(F.col(quoted(df.columns[0])), F.lit("")), 1, 0)
    record = F.regexp_replace(F.concat(_RECORD, nothing), r"[\r\n]+$", "")
    return df.select(*[F.col(quoted(c)) for c in df.columns[:-1]], record.alias(_RECORD), plain_path().alias("__file"), path_end().alias("__end"))


def _cells(record: Column) -> Column:
    """How many cells a record has: commas outside quotes, and one."""
    return F.length(F.regexp_replace(F.regexp_replace(record, '"[^"]*"', ""), "[^,]", "")) + 1


def _fitting(df: DataFrame, columns: int, fill: bool, strict: bool) -> DataFrame:
    """The records that fit their header; ``strict`` fails the job at any other."""
    record, cells = F.col(_RECORD), _cells(F.col(_RECORD))
    bad = record.isNotNull() & (cells > columns) if fill else record.isNotNull()
    if strict:
        text = F.concat(F.lit(f"a record that does not fit its {columns} columns: "), F.col("__file"), F.lit(": "), record)
        return df.where(F.when(bad, F.raise_error(text).cast("boolean")).otherwise(True))
    return df.where(~bad)


def _rejected(df: DataFrame, columns: int, fill: bool) -> DataFrame:
    cells = _cells(F.col(_RECORD))
    found = df.select(F.col("__file").alias("file"), cells.cast("long").alias("cells"), F.lit(columns).cast("long").alias("columns"), F.col(_RECORD).alias("record"))
    return found.where(F.col("record").isNotNull() & (F.col("cells") > columns if fill else F.lit(True)))


def union_monthly(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, columns matched by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_monthly_csv(
    spark: SparkSession,
    files: Sequence[MonthlyFile] | Sequence[str],
    source: str | None = None,
    drop_copies: bool = True,
    encoding: str = CSV_ENCODING,
    rejects: str | None = None,
    short: str = "reject",
) -> DataFrame:
    """All exports as text columns, missing-value texts as null.

    Files are grouped by header and each group is read once with its own schema: one read over
    differing headers would put values into wrong columns. ``source`` names a column for the file name.

    A record with more or fewer cells than its header fails the job. With ``rejects``, such records are written there as a Parquet table
    (file, cells, columns, record) instead, at once, and the others are read. ``short="fill"`` takes records with too few cells: absent cells are
    null. Lines without any character are no records.
    """
    if short not in ("reject", "fill"):
        raise ValueError("short is 'reject' or 'fill'")
    paths = [f.path if isinstance(f, MonthlyFile) else f for f in files]
    if not paths:
        raise FileNotFoundError("no monthly export found")
    groups: dict[FileLook, list[str]] = defaultdict(list)
    for path, look in look_at_files(spark, paths, encoding).items():
        groups[look].append(path)
    read = [(_read_group(spark, look.header, members, look.open_quotes, encoding), len(look.header)) for look, members in groups.items() if look.header]
    if not read:
        raise ValueError("no export has a header")
    fill = short == "fill"
    if rejects:
        reduce(DataFrame.union, [_rejected(df, n, fill) for df, n in read]).write.mode("overwrite").parquet(rejects)
    frames = []
    for df, columns in read:
        df = _fitting(df, columns, fill, strict=not rejects)
        kept = [F.col(quoted(c)) for c in df.columns[:-3]]
        if source:
            kept.append(F.regexp_extract("__end", r"([^/]+[0-9]{6}\.csv)(/[^/]*)?$", 1).alias(source))
        frames.append(df.select(*kept))
    if drop_copies:
        frames = [drop_second_copies(f) for f in frames]
    return normalise_tokens(union_monthly(frames))
