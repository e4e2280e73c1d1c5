"""Balanced label propagation: equal numbers of documents per shard, few links between shards. DataFrame operations only.

Documents of a group are linked with each other. Groups larger than a shard are dealt out first, to as many shards as they
fill. All other linked documents start in an even deal, whatever their group, and are labelled by their shards. Then, in each round, a group's documents
move to the shard where most of their neighbours are, as far as quotas allow: between two shards as many may move
one way as the other, and beyond that as many as the target has room. Every other round looks only at shards with room.
Every move brings more neighbours together, so the rounds end, namely when none of either kind moves anything. A round works on the
number of documents per group and shard, so no pair of neighbours is ever listed. What is left cut then, for want of room where its
neighbours are, is laid over the room that remains. Documents without links fill what is left. In the
end every shard has as many rows as any other, or one more.
"""

from __future__ import annotations

from itertools import accumulate, count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import running_before, salted
from .staging import Scratch

#: So many rounds in a row that move nothing, half of them of each kind and each with other ties, end the propagation.
IDLE_ROUNDS = 4
#: Rows that one window of a numbering holds about.
CELL_ROWS = 50_000


def _quotas(moves: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may move from one shard to another: the exchange, then what fits into the room."""
    free, out = list(room), {}
    for (a, b), wanted in sorted(moves.items()):
        exchange = min(wanted, moves.get((b, a), 0))
        more = min(wanted - exchange, free[b])
        free[b] -= more
        out[a, b] = exchange + more
    return out


def _held(cells: DataFrame, shards: int) -> list[int]:
    held = {row.shard: row.n for row in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [held.get(shard, 0) for shard in range(shards)]


class _Dealer:
    """Places few groups on the driver: whole where one fits best, else in the shards with most room."""

    def __init__(self, room: list[int]):
        self.room, self.dealt = list(room), []

    def deal(self, found) -> None:
        for row in sorted(found, key=lambda r: (-r.n, bytes(r.group))):
            left = row.n
            while left:
                fits = [shard for shard, free in enumerate(self.room) if free >= left]
                shard = min(fits, key=lambda s: self.room[s]) if fits else max(range(len(self.room)), key=lambda s: self.room[s])
                n = min(left, self.room[shard])
                self.dealt.append((bytes(row.group), shard, n))
                self.room[shard] -= n
                left -= n

    def cells(self, spark) -> DataFrame:
        return spark.createDataFrame(self.dealt, "group binary, shard int, n long")


def _even_deal(rows: DataFrame, room: list[int], n_cells: int, scratch: Scratch) -> DataFrame:
    """(group, shard, n): rows (id, group) spread over the room, in proportion to it, in the order of a hash that knows nothing of groups."""
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "group binary, shard int, n long")
    mixed = F.xxhash64("id", "group")
    numbered = running_before(rows.withColumn("mixed", mixed), [], F.col("mixed"), n_cells, [F.col("mixed"), F.col("id"), F.col("group")], F.lit(1), "k")
    # The k-th of all comes where k + 1 of them end, were each shard filled to the same share of its room.
    free, ends = sum(room), list(accumulate(room))
    share = F.array(*[F.lit(end * total // free).cast("long") for end in ends])
    shard = F.size(F.filter(share, lambda e: e <= F.col("k")))
    return scratch.keep(numbered.groupBy("group", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n")), "start")


def _laid_over(groups: DataFrame, room: list[int], n_cells: int, scratch: Scratch) -> DataFrame:
    """(group, shard, n) of groups end to end over the room. Those that the end of a shard cuts, fewer than shards, come to the driver and go where one fits whole."""
    small = running_before(groups, [], F.col("group"), n_cells, [F.col("group")], F.col("n"), "before")
    ends = F.array(*[F.lit(end).cast("long") for end in accumulate(room)])
    first = F.size(F.filter(ends, lambda e: e <= F.col("before")))
    last = F.size(F.filter(ends, lambda e: e < F.col("before") + F.col("n")))
    small = scratch.keep(small.select("group", first.alias("shard"), "n", last.alias("last")), "laid")
    whole = small.where("shard = last").select("group", "shard", "n")
    dealer = _Dealer([free - n for free, n in zip(room, _held(whole, len(room)), strict=True)])
    dealer.deal(small.where("shard < last").collect())
    return whole.union(dealer.cells(groups.sparkSession))


def _propagated(cells: DataFrame, capacity: list[int], n_cells: int, rounds: int | None, scratch: Scratch) -> DataFrame:
    """Move the documents of (group, shard, n) towards their neighbours. What comes to the driver is by shard or pair of shards."""
    spark = cells.sparkSession
    idle = 0
    for turn in count() if rounds is None else range(rounds):
        room = [size - n for size, n in zip(capacity, _held(cells, len(capacity)), strict=True)]
        rank = F.struct("n", F.xxhash64("group", "shard", F.lit(turn)).alias("tie"), "shard")
        target = F.lit(False)
        for shard, size in enumerate(capacity):
            open_to = (F.lit(room[shard]) > 0) if turn % 2 == 0 else (F.col("n") < size)
            target = target | ((F.col("shard") == shard) & open_to)
        best = cells.where(target).groupBy("group").agg(F.max(rank).alias("best"))
        lower = (rank < F.col("best")) | (~target & (F.col("n") <= F.col("best.n")))
        moves = cells.join(best, "group").where(lower & (F.col("shard") != F.col("best.shard")))
        moves = scratch.keep(moves.select("group", "shard", F.col("best.shard").alias("to"), "n"), "moves")
        wanted = {(r.shard, r.to): r.n for r in moves.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        quotas = [(a, b, n) for (a, b), n in _quotas(wanted, room).items() if n]
        if not quotas:
            scratch.drop(moves)
            idle += 1
            if idle == IDLE_ROUNDS:
                break
            continue
        idle = 0
        quota = spark.createDataFrame(quotas, "shard int, to int, quota long")
        before = running_before(moves, ["shard", "to"], F.col("group"), n_cells, [F.col("group")], F.col("n"), "before")
        taken = before.join(F.broadcast(quota), ["shard", "to"])
        taken = taken.withColumn("n", F.least("n", F.col("quota") - F.col("before"))).where("n > 0")
        taken = scratch.keep(taken.select("group", "shard", "to", "n"), "taken")
        changes = taken.select("group", "shard", (-F.col("n")).alias("n")).union(taken.select("group", "to", "n"))
        after = cells.union(changes).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        last, cells = cells, scratch.keep(after, "cells")
        scratch.drop(last, moves, taken)
    return cells


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """(id_col, size, text_crc32, group, law, shard, slot, grown_shard) of every row; law is ``rows``.

    The numbers of rows of any two shards differ by one at most. Documents with equal texts are linked (compared by
    128-bit hash); null counts as the empty text. ``size`` is the bytes of the text and 16. ``slot`` numbers a shard's rows from 0.
    ``grown_shard`` is null: another number of shards means another run. Repeated rows are rows of their own, linked by their
    text; ids may be null. A group larger than a shard fills one and goes on in others. Without ``rounds``, the
    propagation goes on until nothing moves. An empty table gives an empty result. Other columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("group"),
    )
    own = scratch.keep(own, "rows")
    groups = scratch.keep(own.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    n_cells = salted(CELL_ROWS, total)
    capacity = [total // shards + (shard < total % shards) for shard in range(shards)]
    order = [F.col("id"), F.col("group")]

    dealer = _Dealer(capacity)
    dealer.deal(groups.where((F.col("n") > 1) & (F.col("n") > capacity[0])).collect())  # fewer than shards
    large, room = dealer.cells(spark), dealer.room
    linked = groups.where((F.col("n") > 1) & (F.col("n") <= capacity[0]))
    start = _even_deal(own.join(linked.select("group"), "group", "left_semi").select("id", "group"), room, n_cells, scratch)
    moved = _propagated(start, room, n_cells, rounds, scratch)
    spread = moved.groupBy("group").agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("n"))
    spread = scratch.keep(spread, "spread")
    whole = moved.join(spread.where("shards = 1").select("group"), "group", "left_semi")
    left = [free - n for free, n in zip(room, _held(whole, shards), strict=True)]
    cells = large.union(whole).union(_laid_over(spread.where("shards > 1").select("group", "n"), left, n_cells, scratch))
    cells = scratch.keep(cells, "cells")

    # The k-th row of a group goes to the shard in whose share k falls.
    shares = cells.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("shares"))
    rows = own.join(groups.withColumnRenamed("n", "of_group"), "group")
    together = running_before(rows.where("of_group > 1"), ["group"], F.col("id"), n_cells, order, F.lit(1), "k")
    ends = F.transform("shares", lambda x, i: F.aggregate(F.slice("shares", 1, i + 1), F.lit(0).cast("long"), lambda s, y: s + y["n"]))
    together = together.join(shares.select("group", F.col("shares.shard").alias("in"), ends.alias("ends")), "group")
    passed = F.size(F.filter("ends", lambda e: e <= F.col("k")))
    together = together.select(*own.columns, F.get("in", passed).alias("shard"))

    filled = list(accumulate(size - n for size, n in zip(capacity, _held(cells, shards), strict=True)))
    alone = running_before(rows.where("of_group = 1"), [], F.col("id"), n_cells, order, F.lit(1), "k")
    place = F.size(F.filter(F.array(*[F.lit(f).cast("long") for f in filled]), lambda e: e <= F.col("k")))
    alone = alone.select(*own.columns, place.alias("shard"))

    placed = scratch.keep(together.unionByName(alone), "placed")
    numbered = running_before(placed, ["shard"], F.col("id"), n_cells, order, F.lit(1), "slot")
    return numbered.select(
        F.col("id").alias(id_col), "size", "text_crc32", "group", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
