"""Operator 3, sharding by minimax contiguous partition.

Equal texts form one atomic group, placed by the text's 64-bit hash (texts that collide share a group, which keeps
equal texts together). Groups are ordered by that hash, and the order is cut into ``shards`` contiguous stretches
whose largest is as small as possible: a search over the capacity, each candidate checked greedily (fill a shard up
to the capacity, cut, go on).

At scale: group sizes are one partially aggregated pass; running sums go by blocks of the hash range. The smallest
capacity lies between an even share and one largest group above it, so the s-th cut can only fall into a certain
span of bytes. When the spans hold few group ends (at most ``gather``, whatever the table's size) the driver finishes
the binary search over those. Otherwise a round asks ``fan`` capacities at once, one small job per shard: the next cut
of each is the last group that ends within (start + capacity), found in the one block that holds that byte; the round
divides the interval by ``fan`` + 1 and narrows the spans. Block boundaries (at most ``BLOCKS`` numbers) stay on the
driver. The cuts become literals, so rows are placed in the scan, and numbered inside their shards by blocks that
split hot groups.

Defined results: a null text has size 1 and forms a group of its own kind; an empty text too; ids and rows may
repeat; a group larger than an even share sets the capacity; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ordering import BLOCKS, running_sum

_SIGN = 1 << 63


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, crc, group hash ``_h`` and its block (upper bits) ``_block``, a second hash ``_salt``."""
    text = F.col(text_col).cast("string")
    out = df.select(F.col(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                    F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                    F.coalesce(F.xxhash64(text), F.lit(0)).alias("_h"),
                    F.xxhash64(F.col(id_col), F.lit("salt")).alias("_salt"))
    return out.withColumn("_block", (F.shiftright("_h", 64 - BLOCKS.bit_length() + 1) + BLOCKS // 2).cast("int"))


def _next_cuts(groups: DataFrame, ends: list[tuple[int, int]], shards: int, capacities: list[int]) -> list[list[int]]:
    """Where each capacity's greedy filling cuts, by one small job per shard for all capacities."""
    upto, total = [e for _, e in ends], ends[-1][1]
    found: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        goal, asked, blocks = {}, [], set()
        for k, c in enumerate(capacities):
            reach = (found[k][-1] if found[k] else 0) + c
            if reach >= total:
                found[k].append(total)
                continue
            block = bisect_right(upto, reach)  # the block in which that byte lies
            goal[k] = upto[block - 1] if block else 0
            blocks.add(ends[block][0])
            asked.append(f"({k}, {ends[block][0]}, {reach}L)")
        if not asked:
            break
        places = groups.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(asked)} AS t(k, block, reach)")
        hits = groups.where(F.col("_block").isin(sorted(blocks))).join(
            F.broadcast(places), (F.col("_block") == F.col("block")) & (F.col("_end") <= F.col("reach")))
        for r in hits.groupBy("k").agg(F.max("_end").alias("end")).collect():
            goal[r["k"]] = max(goal[r["k"]], r["end"])
        for k, end in goal.items():
            found[k].append(end)
    return found


def _greedy(ends: list[int], shards: int, capacity: int) -> list[int]:
    """The cuts of greedy filling over sorted group ends."""
    cuts: list[int] = []
    while len(cuts) < shards and (not cuts or cuts[-1] < ends[-1]):
        start = cuts[-1] if cuts else 0
        place = bisect_right(ends, start + capacity)
        cuts.append(max(start, ends[place - 1] if place else 0))
    return cuts


def _minimax_cuts(groups: DataFrame, ends: list[tuple[int, int]], shards: int, largest: int, fan: int,
                  gather: int) -> list[int]:
    """The cuts (bytes from the start) of the smallest feasible capacity. ``ends``: block, bytes up to its end."""
    total = ends[-1][1]
    low = max(-(-total // shards), largest)
    high = low + largest  # enough: every shard but the last then holds more than ``low`` - 1 bytes
    # between which bytes a capacity of the interval can make its s-th cut (cuts move up with the capacity)
    spans = [(s * (low - largest), min(total, s * high)) for s in range(1, shards + 1)]
    while True:
        inside = groups.where(reduce(lambda a, b: a | b, [F.col("_end").between(*x) for x in spans]))
        if inside.count() <= gather:
            near = sorted({r["_end"] for r in inside.select("_end").collect()} | {total})
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if _greedy(near, shards, middle)[-1] == total else (middle + 1, high)
            return _greedy(near, shards, low)
        asked = sorted({low + (high - low) * i // (fan + 1) for i in range(fan + 2)})
        cuts = [x + [total] * (shards - len(x)) for x in _next_cuts(groups, ends, shards, asked)]
        first = next(i for i, x in enumerate(cuts) if x[-1] == total)
        if first == 0 or asked[first] - asked[first - 1] == 1:
            return cuts[first]
        low, high = asked[first - 1] + 1, asked[first]
        spans = list(zip(cuts[first - 1], cuts[first]))


def assign(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", fan: int = 255,
           gather: int = 100_000) -> DataFrame:
    """Per row of ``df``: id, size, text_crc32, shard (0 to ``shards`` - 1) and slot (gapless inside the shard).

    ``gather`` bounds the group ends the driver may hold to finish the search, ``fan`` the capacities asked at once.
    """
    rows = _rows(df, id_col, text_col)
    sized = rows.groupBy("_block", "_h").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    sized = stored(sized, "shard-groups")
    ended = running_sum(sized.withColumn("_all", F.lit(0)), ["_all"], ["_block"], [F.col("_h")], {"_before": F.col("_bytes")})
    groups = stored(ended.select("_block", "_h", "_bytes", "_n", (F.col("_before") + F.col("_bytes")).alias("_end")),
                    "shard-ends")
    blocks = groups.groupBy("_block").agg(F.max("_end").alias("e"), F.max("_bytes").alias("m"), F.sum("_n").alias("n"))
    ends = [(r["_block"], r["e"], r["m"], r["n"]) for r in blocks.orderBy("_block").collect()]  # at most BLOCKS rows
    if not ends:
        return rows.select(id_col, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cuts = _minimax_cuts(groups, [x[:2] for x in ends], shards, max(x[2] for x in ends), fan, gather)
    # the first group after each cut
    starts = groups.where((F.col("_end") - F.col("_bytes")).isin(cuts[:-1])).select("_h").collect()
    shard = reduce(lambda a, r: a + (F.col("_h") >= r["_h"]).cast("int"), starts, F.lit(0))
    # blocks with more than twice the mean of rows are cut by the second hash
    mean = max(1.0, sum(x[3] for x in ends) / BLOCKS)
    crowded = [x for x in ends if x[3] > 2 * mean]
    parts = F.lit(1)
    if crowded:
        parts = F.coalesce(F.get(F.array(*[F.lit(-(-x[3] // int(2 * mean + 1))) for x in crowded]), F.array_position(
            F.array(*[F.lit(x[0]) for x in crowded]), F.col("_block")).cast("int") - 1), F.lit(1))
    placed = rows.withColumns({"shard": shard, "_part": F.pmod(F.col("_salt"), parts).cast("int")})
    placed = stored(placed, "shard-rows")
    return running_sum(placed, ["shard"], ["_block", "_part"], [F.col("_h"), F.col("_salt"), F.col(id_col)],
                       {"slot": F.lit(1)}).select(id_col, "size", "text_crc32", "shard", F.col("slot").cast("long"))
