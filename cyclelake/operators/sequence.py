"""Cycle-number sequences within a cell.

Differences between consecutive cycle numbers come from ``lag`` via
:func:`~cyclelake.operators.ordering.ordered_columns` (a window per cell only for cells of bounded size,
halo-chunked windows for larger ones). Missing numbers are reported as ranges ``(gap_start, gap_end)`` instead of expanding
``sequence(min, max)``: a cell numbered by test day can miss thousands of numbers, and a range is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import ordered_columns

CELL = "cell_id"
CYCLE = "regular_cycle_number"
# Fixed value: the jump the reference flags as a "large cycle number gap".
LARGE_GAP = 100


def cycle_steps(cycles: DataFrame, column: str = CYCLE, hot_rows: int | None = None) -> DataFrame:
    """(cell_id, cycle, prev_cycle, step) for every non-null cycle number, in cycle order."""
    nums = cycles.select(CELL, column).filter(F.col(column).isNotNull() & F.col(CELL).isNotNull())
    stepped = ordered_columns(nums, [CELL], column, lambda w: {"prev_cycle": F.lag(column).over(w)}, 1,
                              hot_rows=hot_rows)
    return stepped.select(
        CELL, F.col(column).alias("cycle"), "prev_cycle", (F.col(column) - F.col("prev_cycle")).alias("step"))


def cycle_jumps(cycles: DataFrame, column: str = CYCLE, limit: int = LARGE_GAP) -> DataFrame:
    """I8 per cell: cells with at least one step over ``limit``, how many, and the largest."""
    steps = cycle_steps(cycles, column)
    return (steps.groupBy(CELL)
            .agg(F.count_if(F.col("step") > limit).cast("long").alias("large_gaps"),
                 F.max("step").alias("max_step"))
            .filter(F.col("large_gaps") > 0))


def missing_cycles(cycles: DataFrame, column: str = CYCLE) -> DataFrame:
    """One row per run of missing numbers between a cell's min and max."""
    steps = cycle_steps(cycles, column).filter(F.col("step") > 1)
    return steps.select(
        CELL,
        (F.col("prev_cycle") + 1).alias("gap_start"),
        (F.col("cycle") - 1).alias("gap_end"),
        (F.col("step") - 1).alias("missing_count"),
    )


def sequence_summary(cycles: DataFrame, column: str = CYCLE, limit: int = LARGE_GAP) -> DataFrame:
    """One row: non-positive numbers, cells with a step over ``limit``, cells with gaps, missing numbers."""
    steps = cycle_steps(cycles, column)
    per_cell = steps.groupBy(CELL).agg(
        F.count_if(F.col("step") > limit).alias("_big"),
        F.count_if(F.col("step") > 1).alias("_gaps"),
        F.sum(F.when(F.col("step") > 1, F.col("step") - 1).otherwise(0)).alias("_missing"),
        F.count_if(F.col("cycle") <= 0).alias("_nonpos"),
    )
    return per_cell.agg(
        F.coalesce(F.sum("_nonpos"), F.lit(0)).cast("long").alias("non_positive"),
        F.count_if(F.col("_big") > 0).cast("long").alias("cells_with_jumps"),
        F.count_if(F.col("_gaps") > 0).cast("long").alias("cells_with_gaps"),
        F.coalesce(F.sum("_missing"), F.lit(0)).cast("long").alias("missing_numbers"),
    )
