"""Summaries and profiles (D1-D6, D9-D11, D14, G2) as single aggregates.

Each function is one ``agg`` (or ``groupBy().agg``) so it is one job with map-side partial aggregation;
per-column results are unpivoted with ``inline`` into a long (column_name, ...) table whose row count is the
number of columns, not the number of data rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_infinite
from . import schema as S

CELL = "cell_id"
CYCLE = "regular_cycle_number"
# Key metrics of the selection statistics, and the ratio warning level.
SELECTION_METRICS = ("actual_nominal_capacity_ah", "last_discharge_capacity", "discharge_capacity_retention",
                     "total_cycles")
LOW_CHARGE_DISCHARGE_RATIO = 0.95


def exact_mean(x: Column) -> Column:
    """Mean through a decimal sum of values rounded to 12 places: the same whatever order rows are summed in.
    Values that a decimal can't hold (infinite, NaN, huge) fall back to the plain mean."""
    exact = x.try_cast("decimal(30,12)")
    return F.when(F.count(exact) == F.count(x), F.try_divide(F.sum(exact).cast("double"), F.count(x))).otherwise(F.avg(x))


def battery_metrics(cycles: DataFrame, by: Sequence[str] = (CELL,)) -> DataFrame:
    """Capacity mean/sample std/min/max, retention % (last ÷ first non-null × 100 when first > 0),
    efficiency mean/std, ``total_cycles`` (max cycle) and ``cycle_range`` "min-max".

    ``by=()`` gives the whole-table version, in (cell_id, cycle) order for first/last.
    """
    order = F.struct(*[F.col(c) for c in (CELL, CYCLE) if c not in by and c in cycles.columns]) \
        if not by else F.col(CYCLE)
    cap = F.col("discharge_capacity")
    has = F.when(cap.isNotNull(), order)
    first, last = F.min_by(cap, has), F.max_by(cap, has)
    aggs = [
        exact_mean(cap).alias("capacity_mean"),
        F.stddev_samp(cap).alias("capacity_std"),
        F.min(cap).alias("capacity_min"),
        F.max(cap).alias("capacity_max"),
        F.when(first > 0, last / first * 100).alias("capacity_retention"),
    ]
    if "coulombic_efficiency" in cycles.columns:
        ce = F.col("coulombic_efficiency")
        aggs += [exact_mean(ce).alias("coulombic_efficiency_mean"), F.stddev_samp(ce).alias("coulombic_efficiency_std")]
    if CYCLE in cycles.columns:
        aggs += [F.max(CYCLE).alias("total_cycles"),
                 F.when(F.count(CYCLE) > 0, F.concat_ws("-", F.min(CYCLE).cast("string"),
                                                        F.max(CYCLE).cast("string"))).alias("cycle_range")]
    return cycles.groupBy(*by).agg(*aggs) if by else cycles.agg(*aggs)


def _unpivot_stats(df: DataFrame, columns: Sequence[str], stats: dict[str, callable]) -> DataFrame:
    """One aggregate computing ``stats[name](col)`` for each column, then one output row per column."""
    aggs = [fn(F.col(c)).alias(f"{c}__{name}") for c in columns for name, fn in stats.items()]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"),
                              *[F.col(f"{c}__{name}").cast("double").alias(name) for name in stats])
                     for c in columns])
    return wide.select(F.inline(rows))


def selection_stats(cells: DataFrame, metrics: Sequence[str] = SELECTION_METRICS) -> DataFrame:
    """(column_name, n_selected, mean, min, max, std) for the key metrics that exist."""
    present = [m for m in metrics if m in cells.columns]
    stats = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    out = _unpivot_stats(cells, present, {"n_selected": lambda c: F.count(F.lit(1)), **stats})
    return out.withColumn("n_selected", F.col("n_selected").cast("long"))


def rows_per_cell_stats(cycles: DataFrame) -> DataFrame:
    """D3: min/max/mean/sample std of rows per cell, plus the numeric-column share from the schema."""
    counts = cycles.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"))
    numeric = len(S.numeric_columns(cycles))
    total = len(cycles.columns)
    return counts.agg(
        F.min("n").cast("long").alias("cycles_per_cell_min"),
        F.max("n").cast("long").alias("cycles_per_cell_max"),
        F.avg("n").alias("cycles_per_cell_mean"),
        F.stddev_samp("n").alias("cycles_per_cell_std"),
    ).withColumns({
        "numeric_columns": F.lit(numeric).cast("long"),
        "total_columns": F.lit(total).cast("long"),
        "numeric_ratio": F.lit(numeric / total if total else 0.0),
    })


def completeness(df: DataFrame) -> DataFrame:
    """(column_name, completeness) = non-null share of every column."""
    n = F.count(F.lit(1))
    aggs = [(F.count(F.col(c)) / n).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("completeness")) for c in df.columns])
    return wide.select(F.inline(rows))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, null_count)."""
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0)).alias("null_count"))
                     for c in df.columns])
    return wide.select(F.inline(rows))


def table_summary(df: DataFrame, n_numeric: int | None = None) -> DataFrame:
    """Per column its type, null count and row count; min/max/mean/std for the numeric columns (the first
    ``n_numeric`` of them, if given).

    The reference raises before returning (quirk Q5); this builds the summary it meant to return.
    """
    numeric = S.numeric_columns(df)[:n_numeric]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in df.columns:
        aggs.append(F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__nulls"))
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std")]
    wide = df.agg(*aggs)
    none = F.lit(None).cast("double")
    rows = []
    for c in df.columns:
        st = [F.col(f"{c}__{k}") if c in numeric else none for k in ("min", "max", "mean", "std")]
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.col("__rows").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
            F.coalesce(F.col(f"{c}__nulls"), F.lit(0)).alias("null_count"),
            st[0].alias("min"), st[1].alias("max"), st[2].alias("mean"), st[3].alias("std")))
    return wide.select(F.inline(F.array(*rows)))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: rows, nulls, ±inf count, and min/max/mean/**population** std of finite values."""
    cols = list(columns) if columns is not None else S.numeric_columns(df)

    def finite(c: Column) -> Column:
        x = c.cast("double")
        return F.when(~is_infinite(x), x)

    stats = {
        "total_count": lambda c: F.count(F.lit(1)),
        "null_count": lambda c: F.sum(c.isNull().cast("long")),
        "inf_count": lambda c: F.sum(F.coalesce(is_infinite(c.cast("double")), F.lit(False)).cast("long")),
        "min": lambda c: F.min(finite(c)),
        "max": lambda c: F.max(finite(c)),
        "mean": lambda c: F.avg(finite(c)),
        "std": lambda c: F.stddev_pop(finite(c)),
    }
    out = _unpivot_stats(df, cols, stats)
    return out.withColumns({k: F.col(k).cast("long") for k in ("total_count", "null_count", "inf_count")})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows, duplicates. The distinct count is an aggregate over all columns
    (shuffled by row hash, so no key skew)."""
    n_distinct = df.distinct().agg(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_distinct", n_distinct).withColumn(
        "duplicate_rows", F.col("n_rows") - F.col("n_distinct"))


def unique_ids(df: DataFrame, column: str = CELL) -> DataFrame:
    """Non-null ids, distinct non-null ids, duplicates, passed."""
    return df.agg(F.count(column).alias("n_ids"), F.count_distinct(column).alias("n_unique")).withColumns({
        "duplicate_ids": F.col("n_ids") - F.col("n_unique"),
        "passed": F.col("n_ids") == F.col("n_unique"),
    })


def charge_discharge_ratio(df: DataFrame) -> DataFrame:
    """Mean of charge ÷ discharge (zero or NULL discharge skipped), and whether it is below 0.95."""
    r = F.avg(F.try_divide(F.col("charge_capacity"), F.col("discharge_capacity"))).alias("charge_discharge_ratio")
    return df.agg(r).withColumn("low_ratio_warning",
                                F.col("charge_discharge_ratio") < F.lit(LOW_CHARGE_DISCHARGE_RATIO))
