"""Sharding by minimax contiguous partition of ordered atomic groups.

Groups of equal texts are atomic and ordered by a hash of their text. The smallest capacity for which greedy filling
needs no more shards than asked for is found by binary search, and the order is cut there. The search never sees all
groups: it works on the sizes of hash intervals, which bound every greedy cut from both sides, and asks Spark for finer
intervals, ``DETAIL`` at a time, only where the bounds still differ: around the cuts of all capacities in doubt, or, if
these are too many, around the first cuts in doubt of the middle one. An interval is a prefix of the hash's bits and is
split each time that it is asked for, so the search ends. A group larger than the mean of what is left over
for the other shards gets a shard of its own beforehand (the smallest capacity could not be under its size anyway),
so that one giant group doesn't leave the other shards empty.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Intervals that one round of the search may fetch to the driver.
DETAIL = 1 << 15
#: Rows of a shard that are numbered by one window partition, about.
SLOT_ROWS = 10_000
BITS = 63
SPAN = 1 << BITS


class _Order:
    """What is known of the order: intervals of the hash, each with its groups' count and bytes; gaps hold no groups."""

    def __init__(self, items: list[tuple[int, int, int, int]]):
        """items: (bits, their value, groups, bytes): the hashes that begin with those bits; sorted by hash."""
        self.items = items
        self.ends, at = [0], 0
        for item in items:
            at += item[3]
            self.ends.append(at)
        self.total = at

    def walk(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Lower and upper bounds (bytes before the cut) of each greedy cut."""
        low, high, lows, highs = 0, 0, [], []
        for _ in range(shards):
            low = self.ends[bisect_right(self.ends, low + capacity) - 1]
            reach = high + capacity
            k = bisect_right(self.ends, reach) - 1
            high = self.ends[k] if k >= len(self.items) or self.items[k][2] == 1 else reach
            lows.append(low)
            highs.append(high)
        return lows, highs

    def verdict(self, capacity: int, shards: int) -> bool | None:
        lows, highs = self.walk(capacity, shards)
        return True if lows[-1] >= self.total else False if highs[-1] < self.total else None


    def between(self, lows: list[int], highs: list[int], most: int) -> tuple[list[int], bool]:
        """The intervals of several groups between lower and upper bounds of cuts, from the left; whether these are all."""
        found: list[int] = []
        at = 0
        for x, y in zip(lows, highs, strict=True):
            at = max(at, bisect_right(self.ends, x) - 1)
            while at < len(self.items) and self.ends[at] <= y:
                if self.items[at][2] > 1:
                    found.append(at)
                at += 1
            if len(found) >= most:
                return found[:most], False
        return found, True


def _start(item: tuple[int, int, int, int]) -> int:
    return item[1] << (BITS - item[0])


def _fetch(groups: DataFrame, wanted: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The intervals that make up those of ``wanted``, each split in two at least and as far as ``DETAIL`` in all allows."""
    deeper = 1
    while deeper < BITS and sum(min(item[2], 2 << deeper) for item in wanted) <= DETAIL:
        deeper += 1
    levels = sorted({item[0] for item in wanted})
    prefix = lambda bits: F.shiftrightunsigned("u", BITS - bits)
    part = groups.where(F.col("u").between(_start(wanted[0]), ((wanted[-1][1] + 1) << (BITS - wanted[-1][0])) - 1))
    if len(wanted) > 1 or levels != [0]:
        table = groups.sparkSession.createDataFrame([item[:2] for item in wanted], "bits int, prefix long")  # DETAIL rows at most
        part = part.select("u", "bytes", F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), prefix(b).alias("prefix")) for b in levels])).alias("e"))
        part = part.select("u", "bytes", "e.*").join(F.broadcast(table), ["bits", "prefix"])
    else:
        part = part.withColumn("bits", F.lit(0))
    finer: Column = F.lit(None)
    for b in levels:
        finer = F.when(F.col("bits") == b, prefix(min(BITS, b + deeper))).otherwise(finer)
    part = part.groupBy("bits", finer.alias("cell")).agg(F.count("*").alias("n"), F.sum("bytes").alias("s"))
    return [(min(BITS, r.bits + deeper), r.cell, r.n, r.s) for r in part.collect()]


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the last hash of each shard but the last non-empty one.

    groups: one row per atomic group with ``u`` (its place in the order, from 0 to 2**63-1, unique) and ``bytes``.
    """
    order = _Order(sorted(_fetch(groups, [(0, 0, SPAN, 0)]), key=_start))
    if not order.items:
        return 0, []
    infeasible, feasible = -(-order.total // shards) - 1, order.total
    while True:
        a, b = infeasible, feasible  # narrow both ends to the capacities that the intervals can't settle
        while b - a > 1:
            m = (a + b) // 2
            a, b = (m, b) if order.verdict(m, shards) is False else (a, m)
        infeasible, b = a, feasible
        while b - a > 1:
            m = (a + b) // 2
            a, b = (a, m) if order.verdict(m, shards) else (m, b)
        feasible = b
        lows, highs = order.walk(feasible, shards)
        if feasible - infeasible == 1 and lows == highs:
            last = [order.items[bisect_right(order.ends, x) - 2] for x in lows if x < order.total]
            return feasible, [((item[1] + 1) << (BITS - item[0])) - 1 for item in last]
        most = max(1, DETAIL // 4)
        wanted, whole = order.between(order.walk(infeasible + 1, shards)[0], highs, most)  # every capacity in doubt cuts between these
        if not whole:
            wanted, _ = order.between(*order.walk((infeasible + feasible) // 2, shards), most)
        fresh = _fetch(groups, [order.items[k] for k in wanted]) if wanted else []
        if len(fresh) < len(wanted) or not wanted:
            raise RuntimeError(f"the search for the least capacity stands still between {infeasible} and {feasible}")
        gone = set(wanted)
        order = _Order(sorted([x for k, x in enumerate(order.items) if k not in gone] + fresh, key=_start))


def shard_documents(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Put every row into one of ``shards`` shards whose sizes are near equal, equal texts together.

    A row's size is the UTF-8 bytes of its text plus ``overhead``. Returns id, size, text_crc32, law, shard, slot and
    grown_shard (null under this law). A null text has no bytes and is grouped with the empty one; null or repeated ids
    and repeated rows each get a slot; other columns are ignored; an empty table gives no rows. Slots follow no order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("u"),
    )
    rows = materialize(rows, "sharding-rows")
    groups = materialize(rows.groupBy("u").agg(F.sum("size").alias("bytes")), "sharding-groups")
    total = groups.agg(F.sum("bytes")).first()[0]
    left, alone = total or 0, []
    for u, size in groups.orderBy(F.desc("bytes"), "u").limit(shards - 1).collect():
        if size * (shards - len(alone)) <= left or len(alone) >= shards - 1:
            break
        alone.append(u)
        left -= size
    rest = groups.where(~F.col("u").isin(alone)) if alone else groups
    _, cuts = smallest_capacity(rest, shards - len(alone))
    shard: Column = F.lit(len(alone))
    for last in cuts:
        shard = shard + (F.col("u") > last).cast("int")
    for k, u in enumerate(alone):
        shard = F.when(F.col("u") == u, F.lit(k)).otherwise(shard)
    # Slots: rows are dealt by their id within the shard, so that a group of copies is spread too.
    rows = rows.withColumn("shard", shard.cast("int"))
    parts: Column = F.lit(1)
    for k, n in rows.groupBy("shard").count().collect():
        parts = F.when(F.col("shard") == k, F.lit(1 + n // SLOT_ROWS)).otherwise(parts)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), parts))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")))
    return numbered.join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
