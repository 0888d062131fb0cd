"""Joins of cycles to cell metadata.

The cell table has one row per cell, far fewer rows than the cycle table, but its size still grows with the data. It
is never hinted as broadcast: Spark broadcasts it when the size it knows (of files) or measures (of a shuffle) is
under ``spark.sql.autoBroadcastJoinThreshold``; otherwise both sides are exchanged, so that AQE may split the partitions of hot
cells (:func:`~cyclelake.operators.skew.matched`). A caller that knows the hot cells (:class:`~cyclelake.operators.skew.HotKeys`)
passes them: without any, the join is a plain one, and rows already dealt by cell are not exchanged again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HotKeys, matched

CELL = "cell_id"


def metadata_columns(cycles: DataFrame, cells: DataFrame) -> list[str]:
    """Cell columns the cycle table does not already have (cell_id excluded)."""
    have = set(cycles.columns)
    return [c for c in cells.columns if c != CELL and c not in have]


def join_metadata(cycles: DataFrame, cells: DataFrame, columns: Sequence[str] | None = None,
                  hot: HotKeys | None = None) -> DataFrame:
    """Left join on ``cell_id`` carrying only metadata columns the cycles lack.

    No ``cell_id`` on either side, or nothing new to add, returns the cycles unchanged. Join errors are
    raised, not swallowed. Duplicate ``cell_id`` in ``cells`` would multiply rows: the cell-metadata rule
    set (``unique_ids``) reports it.
    """
    if CELL not in cells.columns or CELL not in cycles.columns:
        return cycles
    new = list(columns) if columns is not None else metadata_columns(cycles, cells)
    new = [c for c in new if c in cells.columns and c not in cycles.columns]
    if not new:
        return cycles
    if hot is None:
        return matched(cycles, cells.select(CELL, *new), CELL, "left")
    return hot.join(cycles, cells.select(CELL, *new)).select(*[F.col(f"`{c}`") for c in (*cycles.columns, *new)])


def semi_join_ids(df: DataFrame, ids: DataFrame | Sequence[int], column: str = CELL, hot: HotKeys | None = None) -> DataFrame:
    """Rows whose ``column`` is in ``ids``.

    A short Python list becomes an ``isin`` predicate (pushed into the parquet scan); a DataFrame of ids is
    a left-semi join, whose strategy Spark picks by size; with ``hot`` it leaves the rows dealt by the column.
    """
    if isinstance(ids, DataFrame):
        key = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
        if hot is not None and hot.key == column:
            return hot.join(df, key, "left_semi")
        return matched(df, key, column, "left_semi")
    return df.filter(F.col(column).isin(list(ids)))
