"""Joins on a key of which one value may hold a third of all rows.

A per-key table that an aggregate has just made is already partitioned by the key, so a plain join on it needs no further
exchange of that side, and AQE then can't split a hot key's partition. Two ways out:

* :class:`HotKeys` (sizes known): the rows of a key over the threshold are dealt to parts of at most about that many rows by the
  hash of the whole row, and the per-key row is copied to each part. Copies are bounded by rows / threshold, and the list of hot
  keys, which is broadcast, by ``MAX_HOT_KEYS`` entries: a larger table raises the threshold instead.
* :func:`matched` (sizes unknown): a null-safe condition, whose keys are computed and so are exchanged anew on both sides;
  AQE may then split the row side.

Keys that are NULL match nothing, as in a plain join; their rows are dealt by hash too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import hot_group_rows

MAX_HOT_KEYS = 10_000
NULL_PARTS = 1024


@dataclass(frozen=True)
class HotKeys:
    """The keys of a table that hold more than ``limit`` rows, and the rows of its largest key."""

    key: str
    largest: int
    limit: int
    parts: DataFrame | None  # (key, parts); None where no key is hot

    def join(self, rows: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
        """``rows`` joined with the per-key ``table`` on the key, no task reading much over ``limit`` rows of one key."""
        if self.parts is None:
            return rows.join(table, self.key, how)
        parts = F.broadcast(self.parts)
        spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce("_parts", F.when(
            F.col(self.key).isNull(), NULL_PARTS), F.lit(1)))
        dealt = rows.join(parts, self.key, "left").withColumn("_part", spread.cast("int")).drop("_parts")
        copies = table.where(F.col(self.key).isNotNull()).join(parts, self.key, "left").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        return dealt.join(copies, [self.key, "_part"], how).drop("_part")


def hot_keys(df: DataFrame, key: str, hot_rows: int | None = None) -> HotKeys:
    """The hot keys of ``df``: one partial aggregate; one row comes back."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    most, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    limit = max(hot_group_rows(df, hot_rows), (total or 0) // MAX_HOT_KEYS, 1)
    parts = sizes.where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    return HotKeys(key, most or 0, limit, parts if (most or 0) > limit else None)


def matched(rows: DataFrame, table: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row per key) so that AQE may split a hot key's rows; ``table``'s key is dropped."""
    own = table.where(F.col(key).isNotNull()).withColumnRenamed(key, f"_match_{key}")
    joined = rows.join(own, rows[key].eqNullSafe(own[f"_match_{key}"]), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(f"_match_{key}")
