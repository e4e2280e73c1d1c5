"""A Merkle manifest of a table: one tree per source, a tree over their roots, and a proof per row.

The manifest is stored as parent-linked node rows: (child, parent, the siblings before and after the child). Trees are built level by
level: every three consecutive nodes become their hash, so no task holds more than three nodes of a level. Rows are numbered within
their source by sorted ranges, never by one window over a source.

A recursive query then climbs from every leaf to the root. A step joins the climbing rows with the node rows, appends the
siblings found there and folds the leaf's (perhaps tampered) hash with them. Climbing rows carry digests as bytes and drop the
siblings of earlier steps, which the query's own rows keep; they are put together once, at the root. The climb has two parts,
so that the many node rows of the lowest ``LOW`` levels are not joined again at every level above them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import Scratch

#: Consecutive nodes that become one.
ARITY = 3
#: Rows that one range of the numbering holds about.
RANGE_ROWS = 50_000
#: Node ids: the level above the position of the node's first leaf; levels of the tree over the sources begin at 64.
LEVEL_BIT, TOP = 56, 64
#: Levels of the first part of the climb; those above hold a twentieth of its node rows.
LOW = 3


def sha256(*parts: Column) -> Column:
    """The digest of concatenated digests, which count as lowercase hexadecimal text."""
    return F.unhex(F.sha2(F.concat(*[F.lower(F.hex(p)) for p in parts]).cast("binary"), 256))


def _text(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256))


def _numbered(rows: DataFrame, key: str, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Add ``at`` (from 0, over all rows in the order of the key, null first, then of ``order``), ``first`` (``at`` of the key's first row) and ``size``.

    Rows are laid out in sorted ranges; a window sees one range. ``order`` must be total.
    """
    n = rows.count()
    by = [F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    ranges = rows.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *by).withColumn("range", F.spark_partition_id())
    ranges = scratch.keep(ranges, name)
    # One row per range; then one row per range and key, of which a key has as many as its ranges.
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*by)) - 1
    ranges = ranges.withColumn("within", within).join(bases, "range").withColumn("at", F.col("base") + F.col("within"))
    whole = Window.partitionBy(key)
    held = ranges.groupBy("range", key).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    held = held.withColumns({"first": F.min("first").over(whole), "size": F.sum("size").over(whole)})
    same = (F.col("r.range") == F.col("h.range")) & F.col(f"r.{key}").eqNullSafe(F.col(f"h.{key}"))
    joined = ranges.alias("r").join(held.alias("h"), same)
    numbers = [F.col(c).cast("long").alias(c.split(".")[1]) for c in ("r.at", "h.first", "h.size")]
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], *numbers)


def build_trees(nodes: DataFrame, level: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of each level (id, parent, before, after, last) and the roots (id, tree, hash) of all trees.

    ``nodes`` are the leaves: (id, tree, at, first, size, hash), ``tree`` a number, ``at`` counting from ``first`` within it. A lone leaf
    is its tree's root. ``last`` marks children of roots and of the nodes of level ``LOW``.
    """
    links, roots = [], []
    now = nodes.select("id", "tree", (F.col("at") - F.col("first")).alias("pos"), "first", "size", "hash")
    span, largest = 1, now.agg(F.max("size")).first()[0] or 0
    while True:
        roots.append(now.where("size = 1").select("id", "tree", "hash"))
        if largest <= 1:
            return links, reduce(DataFrame.union, roots)
        level, span, largest = level + 1, span * ARITY, -(-largest // ARITY)
        kid = F.struct("pos", "id", "hash")
        runs = now.where("size > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("run")).agg(
            F.first("first").alias("first"), F.first("size").alias("size"), F.sort_array(F.collect_list(kid)).alias("kids")
        )
        digest = F.sha2(F.array_join(F.transform("kids", lambda k: _text(k["hash"])), "").cast("binary"), 256)
        runs = runs.select(
            (F.lit(level).cast("long") * (1 << LEVEL_BIT) + F.col("first") + F.col("run") * span).alias("id"), "tree", F.col("run").alias("pos"), "first",
            F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"), F.unhex(digest).alias("hash"), "kids",
        )
        now = scratch.keep(runs, f"level{level}")
        joined = lambda part: F.aggregate(part, F.unhex(F.lit("")), lambda s, k: F.concat(s, k["hash"]))
        own = now.select(F.col("id").alias("parent"), "kids", F.posexplode("kids").alias("place", "kid"), ((F.col("size") == 1) | F.lit(level == LOW)).alias("last"))
        links.append(
            own.select(
                F.col("kid.id").alias("id"), "parent", joined(F.slice("kids", F.lit(1), F.col("place"))).alias("before"),
                joined(F.slice("kids", F.col("place") + 2, F.lit(ARITY))).alias("after"), "last",
            )
        )
        now = now.drop("kids")


@contextmanager
def _unlimited_recursion(spark: SparkSession) -> Iterator[None]:
    """A climb makes one row per leaf and level; its depth is a logarithm of the rows, its rows must not be limited."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _ascent(start: DataFrame, links: DataFrame) -> DataFrame:
    """(leaf, step, node, siblings, folded, last) of every step up from ``start``, of the same columns, and ``start`` itself."""
    spark = start.sparkSession
    start.createOrReplaceTempView("merkle_start")
    links.createOrReplaceTempView("merkle_links")
    digest = "unhex(sha2(cast(concat(lower(hex(before)), lower(hex(folded)), lower(hex(after))) as binary), 256))"
    try:
        return spark.sql(f"""
            with recursive climb(leaf, step, node, siblings, folded, last) as (
                select leaf, step, node, siblings, folded, last from merkle_start
                union all
                select leaf, step + 1, parent, cast(concat(before, after) as binary), {digest}, merkle_links.last
                from climb join merkle_links on climb.node = merkle_links.id
            )
            select * from climb
        """)
    finally:
        spark.catalog.dropTempView("merkle_start")
        spark.catalog.dropTempView("merkle_links")


def climb(leaves: DataFrame, low: DataFrame, high: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, folded, proof) of every leaf (id, hash, size): its hash folded up to the root, and the hash of all siblings met, lowest level first."""
    nothing = F.unhex(F.lit(""))
    start = leaves.select(
        F.col("id").alias("leaf"), F.lit(0).alias("step"), F.col("id").alias("node"), nothing.alias("siblings"), F.col("hash").alias("folded"), (F.col("size") == 1).alias("last")
    )
    with _unlimited_recursion(leaves.sparkSession):
        below = scratch.keep(_ascent(start, low), "below")
        above = _ascent(below.where("last").withColumn("siblings", nothing), high)
        # The second part's first row repeats the last of the first part, without its siblings.
        parts = [part.select("leaf", "step", "siblings", "folded") for part in (below, above)]
        steps = parts[0].union(parts[1])
        met = F.sort_array(F.collect_list(F.struct("step", "siblings")))
        proof = F.aggregate(met, nothing, lambda s, x: F.concat(s, x["siblings"]))
        climbed = steps.groupBy("leaf").agg(F.max_by("folded", "step").alias("folded"), F.unhex(F.sha2(_text(proof).cast("binary"), 256)).alias("proof"))
        return scratch.keep(climbed.withColumnRenamed("leaf", "id"), "climbed")


def manifest(
    docs: DataFrame, columns: list[str], tampered: dict[str, Column] | None = None, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf is the hash of the row's ``columns``. ``tampered`` gives other expressions for some of them; the hash of a row so changed is
    folded with the original siblings, and ``verified`` says whether it gives the root. Digests are lowercase hexadecimal text.

    Null columns count as ``-``. Rows with a null source form a source of their own, the first. Within a source rows go by id (null first),
    then by leaf; rows that tie in both are equal, and each is a leaf of its own. An empty table gives an empty result;
    a single row is leaf, subroot and root at once, and its proof is the hash of the empty text. Other columns are ignored, whatever they are called.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    changed = [(tampered or {}).get(c, F.col(c)) for c in columns]
    rows = docs.select(
        F.col(id_col).alias("own"), F.col(source_col).cast("string").alias("source"), row_digest([F.col(c) for c in columns]).alias("hash"),
        row_digest(changed).alias("other"), F.monotonically_increasing_id().alias("entry"),
    )
    rows = scratch.keep(rows, "rows")
    # The leaf's place among all leaves is its id, the place of its source's first leaf the number of its tree.
    leaves = _numbered(rows, "source", ["own", "hash", "entry"], "ranges", scratch).withColumns({"id": F.col("at"), "tree": F.col("first")})
    leaves = scratch.keep(leaves.select("own", "source", "id", "tree", "at", "first", "size", "hash", "other"), "leaves")
    scratch.drop(rows)
    links, subroots = build_trees(leaves, 0, scratch)
    subroots = scratch.keep(subroots, "subroots")

    # The numbers of the trees are in the order of their sources, so the tree over them needs no source names.
    top = _numbered(subroots.withColumn("all", F.lit(0)), "all", ["tree"], "subranges", scratch)
    top = scratch.keep(top.select("id", F.lit(0).cast("long").alias("tree"), "at", "first", "size", "hash"), "tops")
    upper, roots = build_trees(top, TOP, scratch)
    root = roots.select(_text("hash").alias("root")).first()
    none = "id long, parent long, before binary, after binary, last boolean"
    low, high = [scratch.keep(reduce(DataFrame.union, part, docs.sparkSession.createDataFrame([], none)), "links") for part in (links[:LOW], links[LOW:] + upper)]
    climbed = climb(leaves.select("id", F.col("other").alias("hash"), "size"), low, high, scratch)

    named = subroots.select("tree", _text("hash").alias("subroot"))
    found = leaves.join(climbed, "id").join(named, "tree")
    whole = F.lit(root.root if root else None).cast("string")
    return found.select(
        F.col("own").alias(id_col), _text("hash").alias("leaf"), "subroot", whole.alias("root"), _text("proof").alias("proof_sha256"),
        _text("folded").alias("folded_root"), (_text("folded") == whole).alias("verified"),
    )
