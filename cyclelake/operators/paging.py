"""Pages of a table by a directory of their first keys.

An offset reads and throws away every row before a page, in one task. A directory is made once: one row per page with the key
of its first row. A page is then a range of keys, which the scan filters, so a deep page costs what the first one does.

The order is the chosen columns (NULL first), then a hash of the whole row. Rows equal in every column share a key; a page
that starts among them skips those of earlier pages, and so reads all copies of its first and of the next page's first row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import with_positions

_KEY, _PLACE = "_page_key", "_place"


def _key(df: DataFrame, order_by: Sequence[str]) -> Column:
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order_by)], tie.alias("tie"))


def page_directory(df: DataFrame, order_by: Sequence[str], size: int) -> DataFrame:
    """One row per page: ``page`` (from 0), ``first`` (the key of its first row), ``skip`` (rows of that key on earlier pages)."""
    keys = df.select(_key(df, order_by).alias(_KEY))
    placed = with_positions(keys, [], [_KEY], pos_col=_PLACE, count_col=None)
    runs = placed.groupBy(_KEY).agg(F.min(_PLACE).alias("low"), F.max(_PLACE).alias("high"))
    first, last = F.ceil((F.col("low") - 1) / size), F.floor((F.col("high") - 1) / size)
    starts = runs.where(first <= last).withColumn("page", F.explode(F.sequence(first, last)))
    return starts.select(F.col("page").cast("long").alias("page"), F.col(_KEY).alias("first"),
                         (F.col("page") * size + 1 - F.col("low")).cast("long").alias("skip"))


@dataclass(frozen=True)
class Pages:
    """The pages of ``rows``; ``directory`` is their :func:`page_directory`, as a rule written and read back."""

    rows: DataFrame
    directory: DataFrame
    order_by: tuple[str, ...]
    size: int

    def page(self, number: int) -> DataFrame:
        """Page ``number`` (from 0), in order; empty past the end. Two rows of the directory come to the driver."""
        marks = {r["page"]: r for r in self.directory.where(F.col("page").isin(number, number + 1)).collect()}
        if number not in marks:
            return self.rows.limit(0)
        keyed, kind = self.rows.withColumn(_KEY, _key(self.rows, self.order_by)), self.directory.schema["first"].dataType
        leading = F.col(f"`{self.order_by[0]}`")
        mark = lambda row: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name)
                                      for v, f in zip(row["first"], kind.fields)])
        near = F.col(_KEY) >= mark(marks[number])
        if marks[number]["first"][0] is not None:
            near &= leading >= F.lit(marks[number]["first"][0])  # for the scan
        if after := marks.get(number + 1):
            near &= F.col(_KEY) <= mark(after)
            if after["first"][0] is not None:
                near &= leading.isNull() | (leading <= F.lit(after["first"][0]))
            else:
                near &= leading.isNull()
        return keyed.where(near).orderBy(_KEY).offset(marks[number]["skip"]).limit(self.size).drop(_KEY)
