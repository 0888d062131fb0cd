"""Cell and cycle tables derived from the driver's TPC-H-shaped parquet files.

The engine itself works on any ``cells``/``cycles`` tables (see :mod:`cyclelake.sources.tables`); these
functions only adapt the shared test data to that shape: one part = one cell, its line items in ship order
= its cycles. The same derivation is written as SQL (:data:`CTE_SQL`) for the DuckDB oracle; the Spark side
is DataFrame code and numbers cycles with :func:`with_positions`, a per-cell window that is skew-safe for hot cells.

Derived tables are written once per application under the checkpoint folder and read back, so the queries
that share them do not repeat the derivation and their lineage starts at files.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import TIE, hot_group_rows, with_positions, with_tie
from ..operators.skew import hot_keys
from ..session import materialise


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cycle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    q, disc = F.col("l_quantity"), F.col("l_discount")
    return li.select(
        F.col("l_partkey").cast("long").alias("cell_id"),
        F.col("l_shipdate").alias("test_date"),
        "l_orderkey",
        "l_linenumber",
        q.cast("double").alias("discharge_capacity"),
        F.when(disc == 0, F.lit(0.0))
        .when(F.col("l_returnflag") == "R", F.lit(None).cast("double"))
        .otherwise(q * (F.lit(1) + F.col("l_tax")))
        .alias("charge_capacity"),
        (F.col("l_extendedprice") / 1000).alias("discharge_energy"),
        (F.lit(2.5) + disc * 30).alias("voltage"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R"), F.lit(None).cast("double"))
        .otherwise(q * 3 - 46)
        .alias("temperature"),
        F.when(disc == 0, F.lit(None).cast("double")).otherwise(F.lit(1) - disc).alias("coulombic_efficiency"),
    )


CYCLE_COLUMNS = [
    "cell_id", "regular_cycle_number", "test_date", "discharge_capacity", "charge_capacity",
    "discharge_energy", "voltage", "temperature", "coulombic_efficiency",
]


def input_key(spark: SparkSession, sf_dir: str) -> str:
    """Names the input files, so that a derived table is built anew when files are added under the same path."""
    names = [n for t in ("lineitem", "part") for n in spark.read.parquet(f"{sf_dir}/{t}.parquet").inputFiles()]
    return f"{sf_dir}:{zlib.crc32(chr(0).join(sorted(names)).encode())}"


CYCLE_ORDER = ["test_date", "l_orderkey", "l_linenumber"]


def _numbered(rows: DataFrame, known_hot: bool | None = None) -> DataFrame:
    return with_positions(
        rows, ["cell_id"], CYCLE_ORDER,
        pos_col="regular_cycle_number", count_col=None, known_hot=known_hot,
    ).select(*CYCLE_COLUMNS)


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (cell, cycle); ``regular_cycle_number`` is 1..n in (ship date, order, line) order."""
    return materialise(spark, "cycles", input_key(spark, sf_dir), lambda: _numbered(cycle_rows(spark, sf_dir)))


def cycles_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles numbered by test day instead: ``regular_cycle_number`` = days since the cell's first test + 1.

    Real logs numbered this way have gaps (idle days), jumps and repeats, which the sequence rules look for.
    ``cycle_index`` keeps the original 1..n number as a tie-breaker for rows of the same day. The rows come dealt by cell from
    the numbering, not from the written cycles, so that the join with the first dates doesn't exchange them again.
    """
    def build() -> DataFrame:
        rows = cycle_rows(spark, sf_dir)
        first = rows.groupBy("cell_id").agg(F.min("test_date").alias("_first_date"))
        day = F.datediff(F.to_date("test_date"), F.to_date("_first_date")).cast("long") + F.lit(1)
        hot = hot_keys(rows, "cell_id")
        return (hot.join(_numbered(rows, hot.largest > hot_group_rows(rows)), first, "inner")
                .withColumn("cycle_index", F.col("regular_cycle_number"))
                .withColumn("regular_cycle_number", day)
                .select(*CYCLE_COLUMNS, "cycle_index"))

    return materialise(spark, "cycles_by_day", input_key(spark, sf_dir), build)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").cast("long").alias("cell_id"),
        F.col("p_name").alias("cell_name"),
        F.col("p_brand").alias("design_name"),
        F.col("p_type").alias("experiment_group"),
        (size % 5).cast("string").alias("layer_types"),
        F.when(size % 2 == 0, F.lit("active")).otherwise(F.lit("complete")).alias("test_status"),
        (F.lit(2018) + size % 7).cast("long").alias("test_year"),
        F.when(size % 10 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice") / 1000).alias("total_active_mass_g"),
        size.cast("double").alias("nominal_capacity_ah"),
    )


def _roll(rows: DataFrame, place: Column) -> DataFrame:
    """The roll-up columns of each cell, whose cycles are numbered from 1 to their count in the order of ``place``.

    A task sends one row per cell it holds, with the first and last capacity and their places, so that a hot cell sends no more
    than another.
    """
    cap = F.col("discharge_capacity")
    has_cap = F.when(cap.isNotNull(), place)
    count = F.count(F.lit(1))
    roll = rows.groupBy("cell_id").agg(
        count.alias("regular_cycles"),
        count.alias("total_cycles"),
        F.max_by(cap, has_cap).alias("last_discharge_capacity"),
        F.min_by(cap, has_cap).alias("_first_capacity"),
    )
    return roll.withColumn(
        "discharge_capacity_retention",
        F.when(F.col("_first_capacity") > 0, F.col("last_discharge_capacity") / F.col("_first_capacity")),
    ).drop("_first_capacity")


def cells_rollup(spark: SparkSession, sf_dir: str, cyc: DataFrame | None = None) -> DataFrame:
    """Cells plus the per-cell roll-up columns the cell list shows (count, last cycle, last capacity, last/first).

    The roll-up is a ``groupBy`` with map-side partial aggregation, then a left join on the cell key. It takes the rows as they are
    read, in the order that numbers them, and neither exchanges nor writes the cycles; a query that reads the written cycles
    as well gives them as ``cyc``.
    """
    def build() -> DataFrame:
        if cyc is not None:
            roll = _roll(cyc, F.col("regular_cycle_number"))
        else:
            roll = _roll(with_tie(cycle_rows(spark, sf_dir)), F.struct(*CYCLE_ORDER, TIE))
        return cells(spark, sf_dir).join(roll, "cell_id", "left")

    return materialise(spark, "cells_rollup", input_key(spark, sf_dir), build)


# DuckDB text of the same tables, put in front of every oracle query.
CTE_SQL = """
WITH cycle_rows AS (
  SELECT CAST(l_partkey AS BIGINT) AS cell_id, l_shipdate AS test_date, l_orderkey, l_linenumber,
         CAST(l_quantity AS DOUBLE) AS discharge_capacity,
         CASE WHEN l_discount = 0 THEN CAST(0 AS DOUBLE)
              WHEN l_returnflag = 'R' THEN NULL
              ELSE l_quantity * (1 + l_tax) END AS charge_capacity,
         l_extendedprice / 1000 AS discharge_energy,
         CAST(2.5 AS DOUBLE) + l_discount * 30 AS voltage,
         CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN NULL
              ELSE l_quantity * 3 - 46 END AS temperature,
         CASE WHEN l_discount = 0 THEN NULL ELSE 1 - l_discount END AS coulombic_efficiency
  FROM lineitem
), cycles AS (
  SELECT cell_id,
         CAST(row_number() OVER (PARTITION BY cell_id
              ORDER BY test_date, l_orderkey, l_linenumber) AS BIGINT) AS regular_cycle_number,
         test_date, discharge_capacity, charge_capacity, discharge_energy, voltage, temperature,
         coulombic_efficiency
  FROM cycle_rows
), cycles_by_day AS (
  SELECT cell_id,
         CAST(date_diff('day', CAST(min(test_date) OVER (PARTITION BY cell_id) AS DATE),
                        CAST(test_date AS DATE)) + 1 AS BIGINT) AS regular_cycle_number,
         test_date, discharge_capacity, charge_capacity, discharge_energy, voltage, temperature,
         coulombic_efficiency, regular_cycle_number AS cycle_index
  FROM cycles
), cells AS (
  SELECT CAST(p_partkey AS BIGINT) AS cell_id, p_name AS cell_name, p_brand AS design_name,
         p_type AS experiment_group, CAST(p_size % 5 AS VARCHAR) AS layer_types,
         CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'complete' END AS test_status,
         CAST(2018 + p_size % 7 AS BIGINT) AS test_year,
         CASE WHEN p_size % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice / 1000 END AS total_active_mass_g,
         CAST(p_size AS DOUBLE) AS nominal_capacity_ah
  FROM part
), cell_roll AS (
  SELECT cell_id, CAST(count(*) AS BIGINT) AS regular_cycles, max(regular_cycle_number) AS total_cycles,
         arg_max(discharge_capacity, CASE WHEN discharge_capacity IS NOT NULL THEN regular_cycle_number END)
           AS last_discharge_capacity,
         arg_min(discharge_capacity, CASE WHEN discharge_capacity IS NOT NULL THEN regular_cycle_number END)
           AS first_capacity
  FROM cycles GROUP BY cell_id
), cells_rollup AS (
  SELECT c.*, r.regular_cycles, r.total_cycles, r.last_discharge_capacity,
         CASE WHEN r.first_capacity > 0 THEN r.last_discharge_capacity / r.first_capacity END
           AS discharge_capacity_retention
  FROM cells c LEFT JOIN cell_roll r USING (cell_id)
)
"""
