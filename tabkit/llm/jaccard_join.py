"""N-gram Jaccard join: documents whose shingle sets are alike, as classes and components.

Texts with equal sets form a class; only classes go on. Shingles are ordered rare first (by the count of
their bucket in a table of fixed size, then by hash; the table leaves out those that don't repeat among some thousand documents), and a class is listed under its first shingles: two sets
as alike as asked share one of them. A listed pair must pass the length filter and, at its first common
shingle, the positional filter; pairs are then made distinct and must pass the suffix filter (common shingles are at most
the sum, over parts of the hash range, of the smaller count). What is left is verified once on the whole sets.

All pairs of a group would grow with its square. A list therefore compares one member, the one whose
shingles are shared most, with the others; what links becomes one component, and only members of
different components still have to meet. Each round compares more members that way, outside the largest component of their list,
until the pairs left over are about as many as the entries of the lists; then all of these are compared. No link
between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .staging import Scratch
from .text import LOWER, Texts, find_words, mix, pieces, range_hashes, shingle_hashes

#: Buckets of the table of shingle counts, which every task gets; fixed, so that its size is.
ORDER_BITS = 20
#: So many shingles are looked at together for the count; what occurs once among them is rare and would only blur the table.
COUNTED_TOGETHER = 1 << 22
#: Parts of the suffix filter.
PARTS = 32
#: Up to so many ids, the documents to verify are found by a broadcast, otherwise by a shuffle.
BROADCAST_IDS = 500_000
MAX_ROUNDS = 8
#: About so many leaves are held against their hub's set in one task; the set of a hub with more goes to several.
LEAVES_TOGETHER = 256
#: A round compares so many times as many members of a list as the one before.
MORE = 32


def text_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    data = LOWER[texts.data]
    words = find_words(texts._replace(data=data))
    hashes = range_hashes(data, words.start, words.end)
    return [np.unique(shingle_hashes(hashes[a:b], size)) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def set_id(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty set."""
    if not len(shingles):
        return None
    with np.errstate(over="ignore"):
        one = mix(shingles * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
        two = mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return mix(np.array([one, two + np.uint64(len(shingles))])).tobytes()


def _flat(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


class _Repeats:
    """Counts, by bucket, the shingles that occur in several of the sets given together."""

    def __init__(self):
        self.counts = np.zeros(1 << ORDER_BITS, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.waiting += sets
        self.size += sum(len(s) for s in sets)
        if self.size >= COUNTED_TOGETHER:
            self.count()

    def count(self) -> None:
        if self.waiting:
            shingles, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            bucket = (shingles[n > 1] >> np.uint64(64 - ORDER_BITS)).astype(np.int64)
            self.counts += np.bincount(bucket, n[n > 1], len(self.counts)).astype(np.int64)
        self.waiting, self.size = [], 0


def digests(docs: DataFrame, size: int) -> DataFrame:
    """Per document (id, n, set) and, from each task, how often shingles of each bucket repeat (bucket, n)."""

    def rows(is_count: bool, ids: pa.Array, bucket: pa.Array, n, sets: list) -> pa.RecordBatch:
        columns = [pa.array([is_count] * len(n), pa.bool_()), ids, bucket, pa.array(n, pa.int64()), pa.array(sets, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["is_count", "id", "bucket", "n", "set"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = _Repeats()
        for batch in batches:
            n, names = [], []
            for texts in pieces(batch.column(1)):
                sets = text_sets(texts, size)
                n += [len(s) for s in sets]
                names += [set_id(s) for s in sets]
                repeats.add(sets)
            yield rows(False, batch.column(0), pa.nulls(len(n), pa.int32()), n, names)
        repeats.count()
        used = np.flatnonzero(repeats.counts)
        yield rows(True, pa.nulls(len(used), pa.int64()), pa.array(used, pa.int32()), repeats.counts[used], [None] * len(used))

    return docs.mapInArrow(digested, "is_count boolean, id long, bucket int, n long, set binary")


def rare_first(counts: DataFrame) -> np.ndarray:
    """The rank of each bucket, rarest first; a row per bucket comes to the driver."""
    table = np.zeros(1 << ORDER_BITS, np.int64)
    got = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table[got["bucket"].to_numpy()] = got["n"].to_numpy()
    rank = np.empty(len(table), np.uint64)
    rank[np.argsort(table, kind="stable")] = np.arange(len(table), dtype=np.uint64)
    return rank


def ordered(shingles: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in rare-first order, its shingles renamed so that numbers sort that way."""
    low = np.uint64(64 - ORDER_BITS)
    return np.sort((rank[shingles >> low] << low) | (shingles & np.uint64((1 << (64 - ORDER_BITS)) - 1)))


def prefix_length(n: int, num: int, den: int) -> int:
    """Sets of n shingles with similarity num/den to another share one of so many of their first."""
    return n - (-(-n * num // den)) + 1


def listings(docs: DataFrame, size: int, rank, num: int, den: int) -> DataFrame:
    """Per document: its set, size, first shingles in rare-first order, and counts by part of the hash range."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(0)):
                sets = [s for s in text_sets(texts, size) if len(s)]
                found, names = [ordered(s, rank.value) for s in sets], [set_id(s) for s in sets]
                parts = [np.bincount(s & np.uint64(PARTS - 1), minlength=PARTS) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.binary()),
                        pa.array([len(s) for s in found], pa.int32()),
                        _flat([s[: prefix_length(len(s), num, den)].view(np.int64) for s in found], pa.int64()),
                        _flat(parts, pa.int32()),
                    ],
                    names=["set", "n", "first", "parts"],
                )

    return docs.mapInArrow(listed, "set binary, n int, first array<long>, parts array<int>")


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """(set, shingles) of the texts; a task gives a set once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in batches:
            for texts in pieces(batch.column(0)):
                found = {set_id(s): s for s in text_sets(texts, size) if len(s)}
                found = {name: s for name, s in found.items() if name not in given}
                given.update(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()), _flat([s.view(np.int64) for s in found.values()], pa.int64())],
                    names=["set", "shingles"],
                )

    return docs.mapInArrow(sets, "set binary, shingles array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, reps: DataFrame, docs: DataFrame, size: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The distinct pairs (hub, leaf, need) whose sets have ``need`` shingles in common, as (a, b).

    Sets are long and pairs short. So the pairs go to the leaves' sets where those are made, and a leaf's set travels once
    per pair, to its hub; there are far fewer hubs than leaves. The leaves of a hub that has many are dealt
    into parts, each of which gets the hub's set, so that no task gets them all.
    """
    side = nodes.select("set", "parts")
    held = pairs.join(side.toDF("hub", "parts_a"), "hub").join(side.toDF("leaf", "parts_b"), "leaf")
    common = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    held = scratch.keep(held.where(common >= F.col("need")).select("hub", "leaf", "need"), "pairs")
    n_pairs = held.count()
    few = n_pairs <= BROADCAST_IDS
    # Hubs of more than one part: at most n_pairs / LEAVES_TOGETHER rows.
    many = held.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(LEAVES_TOGETHER)).alias("parts")).where("parts > 1")
    many = scratch.keep(many, "many")
    any_many = not many.isEmpty()
    if n_pairs <= BROADCAST_IDS * LEAVES_TOGETHER:
        many = F.broadcast(many)
    parts = F.coalesce("parts", F.lit(1).cast("long"))

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    def sets_of(column: str) -> DataFrame:
        ids = scratch.keep(held.select(F.col(column).alias("set")).distinct().join(reps, "set").select("id").distinct(), "ids")
        # A set held only by rows without an id has none to be found by: then all such rows are looked through.
        ids = sent(ids.withColumnRenamed("id", "__id"))
        return whole_sets(docs.join(ids, F.col("id").eqNullSafe(F.col("__id")), "left_semi").select("text"), size)

    asked, sets = held.withColumn("part", F.lit(0).cast("long")), sets_of("hub").select(F.col("set").alias("hub"), F.col("shingles").alias("of_hub"))
    if any_many:
        asked = held.join(many, "hub", "left").withColumn("part", F.pmod(F.xxhash64("leaf"), parts))
        sets = sets.join(many, "hub", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    else:
        sets = sets.withColumn("part", F.lit(0).cast("long"))
    leaves = sets_of("leaf").join(sent(asked), F.col("set") == F.col("leaf")).select("hub", "part", "leaf", "need", F.col("shingles").alias("of_leaf"))
    hubs = sets.select("hub", "part", "of_hub").dropDuplicates(["hub", "part"])
    both = leaves.join(hubs, ["hub", "part"]).where(F.size(F.array_intersect("of_leaf", "of_hub")) >= F.col("need"))
    links = scratch.keep(both.select(F.least("hub", "leaf").alias("a"), F.greatest("hub", "leaf").alias("b")).distinct(), "links")
    scratch.drop(held)
    return links


def _needed(n_a, n_b, num: int, den: int):
    """The least number of common shingles for similarity num/den."""
    return F.ceil(((n_a + n_b) * num).cast("long") / F.lit(float(num + den))).cast("int")


def _candidates(one: DataFrame, entries: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (hub, leaf, need) of each row of ``one`` (token, p, p_n, p_pos, p_root) with the entries of its list in other components."""
    met = one.join(entries, "token").where((F.col("p") != F.col("set")) & (F.col("p_root") != F.col("root")))
    least, most = F.least("n", "p_n"), F.greatest("n", "p_n")
    need = _needed(F.col("n"), F.col("p_n"), num, den)
    room = F.least(F.col("n") - F.col("pos"), F.col("p_n") - F.col("p_pos"))
    met = met.where((least * den >= most * num) & (room >= need)).select("p", "set", need.alias("need"))
    pair = met.groupBy(F.least("p", "set").alias("a"), F.greatest("p", "set").alias("b")).agg(
        F.max("need").alias("need"), F.max(F.col("p") == F.least("p", "set")).alias("a_asks")
    )
    return pair.select(
        F.when(F.col("a_asks"), F.col("a")).otherwise(F.col("b")).alias("hub"),
        F.when(F.col("a_asks"), F.col("b")).otherwise(F.col("a")).alias("leaf"),
        "need",
    )


def _picked(minor: DataFrame, most: int) -> DataFrame:
    """At most ``most`` members of every list: all of a shorter one, else the one that is shared most of each of ``most`` parts by hash.

    Which members are picked decides on the work alone. A list is never sorted or gathered: its parts are summed up where they lie.
    """
    size = F.when(F.col("c") == 1, F.col("g")).otherwise(F.col("g") - F.col("c"))
    columns = ["token", "set", "n", "pos", "root"]
    part = F.pmod(F.xxhash64("set"), F.lit(most)).alias("part")
    tops = minor.where(size > most).groupBy("token", part).agg(F.max(F.struct("weight", "set", "n", "pos", "root")).alias("top"))
    return minor.where(size <= most).select(*columns).union(tops.select("token", "top.set", "top.n", "top.pos", "top.root"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5
) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of ``shingle``-word shingles is ``num/den`` or more;
    ``component_id`` is the smallest id reachable by links. Words are runs of bytes other than space and 09 to 0D, A-Z lower-cased;
    with fewer words than a shingle has, all of them are the one shingle. Null and empty texts, and texts without words, have
    no shingles and link with nothing. Repeated rows link like any equal texts; rows without an id take part but never name a
    component. An empty table gives an empty result. Other columns are ignored. Shingles and sets are compared by 64- and 128-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    both = scratch.keep(digests(own, shingle), "digests", ("is_count",))
    digest = both.where(~F.col("is_count")).select("id", "n", "set")
    rank = spark.sparkContext.broadcast(rare_first(both.where("is_count")))
    reps = digest.where("n > 0").groupBy("set").agg(F.min("id").alias("id"))

    nodes = scratch.keep(listings(own.select("text"), shingle, rank, num, den).dropDuplicates(["set"]), "nodes")
    entries = nodes.select("set", "n", F.posexplode("first").alias("pos", "token"))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    entries = scratch.keep(entries.join(shared, "token"), "entries")
    weight = entries.groupBy("set").agg(F.sum("holders").alias("weight"))
    weighted = scratch.keep(entries.drop("holders").join(weight, "set"), "entries")
    scratch.drop(entries)
    entries = weighted
    n_entries = entries.count()
    roots, links = None, []
    for turn in range(MAX_ROUNDS + 1):
        if roots is None:
            lists = entries.withColumn("root", F.col("set"))
        else:
            lists = entries.join(roots, F.col("set") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set")).drop("node")
        by_root = lists.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
        groups = by_root.groupBy("token").agg(F.sum("c").alias("g"), F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("k"))
        groups = scratch.keep(groups.where("k > 1").select("token", "g", F.col("top.c").alias("c"), F.col("top.root").alias("top_root")), "groups")
        left, rows = groups.agg(F.sum(F.col("g") * (F.col("g") - F.col("c")).cast("double")), F.sum("g")).first()
        if not rows:
            break
        lists = scratch.keep(lists.join(groups, "token"), "lists")
        last = turn == MAX_ROUNDS or (turn > 0 and left <= 4.0 * n_entries)
        minor = lists.where((F.col("root") != F.col("top_root")) | (F.col("c") == 1))
        if not last:
            minor = _picked(minor, MORE**turn)
        one = minor.select("token", F.col("set").alias("p"), F.col("n").alias("p_n"), F.col("pos").alias("p_pos"), F.col("root").alias("p_root"))
        if not last:
            one = scratch.keep(one, "picked")
        members = lists.select("token", "set", "n", "pos", "root")
        pairs = _candidates(one, members, num, den)
        links.append(_verified(pairs, nodes, reps, own, shingle, num, den, scratch))
        found = links[0]
        for more in links[1:]:
            found = found.union(more)
        roots = components(found, scratch)
        if last:
            break
        done = one.select("token", F.col("p").alias("set"))
        entries = lists.select("set", "token", "n", "pos", "weight").join(done, ["token", "set"], "left_anti")
        entries = scratch.keep(entries, "entries")
        scratch.drop(lists, one, groups)

    if roots is None:
        named = reps.select("set", F.col("id").alias("component_id"))
    else:
        to_root = reps.join(roots, F.col("set") == F.col("node"), "left").select("set", F.coalesce("root", "set").alias("root"), "id")
        smallest = to_root.groupBy("root").agg(F.min("id").alias("component_id"))
        named = to_root.join(smallest, "root").select("set", "component_id")
    out = digest.join(named, "set", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
