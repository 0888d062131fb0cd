"""Connected components of a written table of links, and the blocked comparison of bucket members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b): the smallest node it is connected with.

    Each round maps every node to the neighbour (or itself) of least hash and replaces the nodes of each link by
    their images; about half of the nodes vanish a round, hubs at once. Rounds are written tables; minima are
    partially aggregated, and joins read written tables, so that Spark may split a hub's partition. Nothing is
    collected but whether links are left.
    """
    spark = links.sparkSession
    left = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "links")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("n"))
        both = left.select(F.col("a").alias("node"), F.least(rank("a"), rank("b")).alias("to")).union(
            left.select(F.col("b").alias("node"), F.least(rank("a"), rank("b")).alias("to")))
        image = stored(both.groupBy("node").agg(F.min("to")["n"].alias("to")), "images")
        maps.append(image)
        first = left.join(image.select(F.col("node").alias("a"), F.col("to").alias("c")), "a")
        moved = first.join(image.select(F.col("node").alias("b"), F.col("to").alias("d")), "b").where("c <> d")
        left = stored(moved.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "links")
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    roots = maps.pop()
    while maps:
        later = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        joined = maps.pop().join(later, "to", "left")
        roots = joined.select("node", F.coalesce("root", "to").alias("to"))
    roots = stored(roots, "roots")
    least = stored(roots.groupBy("to").agg(F.min("node").alias("component")), "least")
    return stored(roots.join(least, "to").select("node", "component"), "components")


def pair_blocks(members: DataFrame, bucket: list[Column], blocks: Column, salt: Column, block: str = "_i") -> DataFrame:
    """Replicate each member to the pairs of its block with every block of its bucket: adds ``_pair`` and ``_side``.

    A bucket of n members in ``blocks`` = n / size blocks becomes pairs of blocks, each of which one task compares
    in bounded memory; together they hold every pair of members once. (Two block pairs whose hash collides are
    compared together, which only adds comparisons.)
    """
    own = members.withColumns({"_n": blocks, block: F.pmod(salt, blocks).cast("int")})
    copies = own.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    low, high = F.least(block, "_j"), F.greatest(block, "_j")
    return copies.withColumns({"_pair": F.xxhash64(*bucket, low, high), "_side": F.when(F.col(block) <= F.col("_j"), 0)
                               .otherwise(1), "_same": F.col(block) == F.col("_j")}).drop("_n", block, "_j")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups from batches sorted by ``key``, with the places where groups begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(key).to_numpy()
        last = int(np.searchsorted(values, values[-1], side="left"))
        if held and held[-1].column(key)[-1].as_py() != values[0]:
            yield _with_starts(held, key)
            held = []
        if last:
            yield _with_starts([*held, batch.slice(0, last)], key)
            held = []
        held.append(batch.slice(last))
    if held:
        yield _with_starts(held, key)


def _with_starts(batches: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    values = table.column(key).to_numpy()
    return table, np.flatnonzero(np.append(True, values[1:] != values[:-1]))
