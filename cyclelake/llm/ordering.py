"""Running sums and gapless numbers over a global or per-group order, without gathering a group in one task.

Rows are dealt to *blocks*: consecutive stretches of the order, about ``BLOCKS`` over the whole table whatever its
size, and a stretch that holds more than its even share is cut further by a second hash. Windows then run inside
blocks only, and the blocks' own sums (a table of at most a few times ``BLOCKS`` rows) are summed up in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCKS = 4096


def unit(key: Column) -> Column:
    """A 64-bit hash as a number in [0, 1): its upper 53 bits."""
    return F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))


def running_sum(df: DataFrame, group: list[str], block: list[str], order: list[Column], sums: dict[str, Column],
                inside: list[Column] | None = None) -> DataFrame:
    """``df`` with exclusive running sums over ``group`` in the order of (``block``, ``order``).

    ``block`` columns are ordered; rows of one (group, block) meet in one task, a group's blocks are summed in one.
    ``df`` is read twice, so it should be a written table.
    """
    totals = df.groupBy(*group, *block).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    over = W.partitionBy(*group).orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_b_{c}") for c in (*group, *block)],
                           *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_before_{n}") for n in sums])
    own = W.partitionBy(*group, *block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = df.withColumns({f"_inside_{n}": F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    match = [inner[c].eqNullSafe(before[f"_b_{c}"]) for c in (*group, *block)]
    joined = inner.join(before, match)
    return joined.withColumns({n: F.col(f"_before_{n}") + F.col(f"_inside_{n}") for n in sums}).drop(
        *before.columns, *[f"_inside_{n}" for n in sums])
