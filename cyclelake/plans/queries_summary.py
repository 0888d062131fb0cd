"""Summary, profile, whole-column outlier, unit and time-bin queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timebins, units
from ..functions.columns import ieee_divide, null_infinity, r6
from ..operators import outliers as OUT
from ..operators import summary as SM
from ..operators.ordering import ordered_columns
from ..sources import fixtures as fx
from .catalog import register
from .queries_cells import rounded

CYCLE_COLS = fx.CYCLE_COLUMNS
NUMERIC = ["cell_id", "regular_cycle_number", "discharge_capacity", "charge_capacity", "discharge_energy",
           "voltage", "temperature", "coulombic_efficiency"]


def _union(selects: list[str]) -> str:
    return "\nUNION ALL ".join(selects)


@register("cell_metrics", """
SELECT cell_id,
  round(CAST(sum(CAST(discharge_capacity AS DECIMAL(30,12))) AS DOUBLE) / count(discharge_capacity), 6) AS capacity_mean, round(stddev_samp(discharge_capacity), 6) AS capacity_std,
  round(min(discharge_capacity), 6) AS capacity_min, round(max(discharge_capacity), 6) AS capacity_max,
  round(CASE WHEN arg_min(discharge_capacity, CASE WHEN discharge_capacity IS NOT NULL THEN regular_cycle_number END) > 0
        THEN arg_max(discharge_capacity, CASE WHEN discharge_capacity IS NOT NULL THEN regular_cycle_number END)
           / arg_min(discharge_capacity, CASE WHEN discharge_capacity IS NOT NULL THEN regular_cycle_number END) * 100
        END, 6) AS capacity_retention,
  round(CAST(sum(CAST(coulombic_efficiency AS DECIMAL(30,12))) AS DOUBLE) / count(coulombic_efficiency), 6) AS coulombic_efficiency_mean,
  round(stddev_samp(coulombic_efficiency), 6) AS coulombic_efficiency_std,
  max(regular_cycle_number) AS total_cycles,
  CAST(min(regular_cycle_number) AS VARCHAR) || '-' || CAST(max(regular_cycle_number) AS VARCHAR) AS cycle_range
FROM cycles GROUP BY cell_id""")
def cell_metrics(spark, sf):
    """D1 per cell."""
    return rounded(SM.battery_metrics(fx.cycles(spark, sf)))


_SEL = ["last_discharge_capacity", "discharge_capacity_retention", "total_cycles"]


@register("selection_stats", _union([
    f"SELECT '{m}' AS column_name, CAST(count(*) AS BIGINT) AS n_selected, round(avg({m}), 6) AS mean, "
    f"round(CAST(min({m}) AS DOUBLE), 6) AS min, round(CAST(max({m}) AS DOUBLE), 6) AS max, "
    f"round(stddev_samp({m}), 6) AS std FROM cells_rollup WHERE test_year = 2021" for m in _SEL]))
def selection_stats(spark, sf):
    """D2 over the cells a filter selects (test year 2021)."""
    cells = fx.cells_rollup(spark, sf).filter(F.col("test_year") == 2021)
    return rounded(SM.selection_stats(cells))


@register("rows_per_cell_stats", """
SELECT CAST(min(n) AS BIGINT) AS cycles_per_cell_min, CAST(max(n) AS BIGINT) AS cycles_per_cell_max,
       round(avg(n), 6) AS cycles_per_cell_mean, round(stddev_samp(n), 6) AS cycles_per_cell_std,
       CAST(8 AS BIGINT) AS numeric_columns, CAST(9 AS BIGINT) AS total_columns,
       round(8.0 / 9.0, 6) AS numeric_ratio
FROM (SELECT cell_id, count(*) AS n FROM cycles GROUP BY cell_id)""")
def rows_per_cell_stats(spark, sf):
    """D3."""
    return rounded(SM.rows_per_cell_stats(fx.cycles(spark, sf)))


@register("completeness", _union([
    f"SELECT '{c}' AS column_name, round(count({c}) / count(*), 6) AS completeness FROM cycles" for c in CYCLE_COLS]))
def completeness(spark, sf):
    """D4."""
    return rounded(SM.completeness(fx.cycles(spark, sf)))


@register("column_profile", _union([
    f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS total_count, "
    f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
    f"CAST(count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE))) AS BIGINT) AS inf_count, "
    f"round(min(CASE WHEN NOT isinf(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END), 6) AS min, "
    f"round(max(CASE WHEN NOT isinf(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END), 6) AS max, "
    f"round(avg(CASE WHEN NOT isinf(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END), 6) AS mean, "
    f"round(stddev_pop(CASE WHEN NOT isinf(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END), 6) AS std "
    f"FROM cycles" for c in NUMERIC]))
def column_profile(spark, sf):
    """D6 over every numeric cycle column."""
    return rounded(SM.column_profile(fx.cycles(spark, sf)))


_DTYPES = {"cell_id": "bigint", "regular_cycle_number": "bigint", "test_date": "timestamp_ntz"}


def _summary_row(c: str) -> str:
    stats = (f"round(CAST(min({c}) AS DOUBLE), 6), round(CAST(max({c}) AS DOUBLE), 6), round(avg({c}), 6), "
             f"round(stddev_samp({c}), 6)") if c != "test_date" else \
        "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
    return (f"SELECT '{c}' AS column_name, '{_DTYPES.get(c, 'double')}' AS dtype, CAST(count(*) AS BIGINT) AS n_rows, "
            f"CAST({len(CYCLE_COLS)} AS BIGINT) AS n_columns, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
            f"{stats.replace(', ', ' AS x, ', 0)} FROM cycles")


@register("table_summary", _union([
    f"SELECT '{c}' AS column_name, '{_DTYPES.get(c, 'double')}' AS dtype, CAST(count(*) AS BIGINT) AS n_rows, "
    f"CAST({len(CYCLE_COLS)} AS BIGINT) AS n_columns, CAST(count(*) - count({c}) AS BIGINT) AS null_count, " + (
        f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, "
        f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std" if c != "test_date" else
        "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, "
        "CAST(NULL AS DOUBLE) AS std") + " FROM cycles" for c in CYCLE_COLS]))
def table_summary(spark, sf):
    """D5."""
    return rounded(SM.table_summary(fx.cycles(spark, sf)))


@register("duplicate_rows", """
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST((SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (cycle_index) FROM cycles_by_day)) AS BIGINT) AS n_distinct,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (cycle_index) FROM cycles_by_day)) AS BIGINT)
         AS duplicate_rows
FROM cycles_by_day""")
def duplicate_rows(spark, sf):
    """Rows of the day-numbered log that repeat in every measured column (the running index left out)."""
    return SM.duplicate_rows(fx.cycles_by_day(spark, sf).drop("cycle_index"))


@register("null_counts", _union([
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM cycles"
    for c in CYCLE_COLS]))
def null_counts(spark, sf):
    """D11."""
    return SM.null_counts(fx.cycles(spark, sf))


@register("charge_discharge_ratio", """
SELECT round(avg(CASE WHEN discharge_capacity <> 0 THEN charge_capacity / discharge_capacity END), 6)
         AS charge_discharge_ratio,
       avg(CASE WHEN discharge_capacity <> 0 THEN charge_capacity / discharge_capacity END) < 0.95 AS low_ratio_warning
FROM cycles""")
def charge_discharge_ratio(spark, sf):
    """D14."""
    return rounded(SM.charge_discharge_ratio(fx.cycles(spark, sf)))


# ---------------------------------------------------------------- H9-H11 on events.value
@register("outliers_iqr", """
, q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value, (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS value_outlier
FROM events, q""")
def outliers_iqr(spark, sf):
    """H9: IQR 1.5 with linear quartiles over the whole column."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    return OUT.iqr_outliers(ev, "value")


@register("outliers_zscore", """
, s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)
SELECT event_id, value, abs((value - m) / nullif(sd, 0)) > 3 AS value_outlier FROM events, s""")
def outliers_zscore(spark, sf):
    """|z| > 3 with the population std."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    return OUT.zscore_outliers(ev, "value")


@register("outliers_modz", """
, med AS (SELECT quantile_cont(value, 0.5) AS m FROM events)
, mad AS (SELECT quantile_cont(abs(value - m), 0.5) AS d FROM events, med)
SELECT event_id, value, abs(0.6745 * (value - m) / nullif(d, 0)) > 3.5 AS value_outlier FROM events, med, mad""")
def outliers_modz(spark, sf):
    """Modified z-score with median and MAD (two passes)."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    return OUT.modified_zscore_outliers(ev, "value")


# ---------------------------------------------------------------- H2
@register("infinity_cleanup", """
, raw AS (
  SELECT cell_id, cycle_index, regular_cycle_number, discharge_capacity,
         (discharge_capacity - lag(discharge_capacity) OVER w)
           / CAST(regular_cycle_number - lag(regular_cycle_number) OVER w AS DOUBLE) AS fade
  FROM cycles_by_day WINDOW w AS (PARTITION BY cell_id ORDER BY regular_cycle_number, cycle_index))
SELECT cell_id, cycle_index, regular_cycle_number, discharge_capacity,
       round(CASE WHEN isinf(fade) THEN NULL ELSE fade END, 6) AS discharge_capacity_fade_rate
FROM raw""")
def infinity_cleanup(spark, sf):
    """H2 on the reference's raw fade rate over day-numbered cycles: repeated days give ±inf (→ NULL) or NaN (kept)."""
    days = fx.cycles_by_day(spark, sf)
    x, c = F.col("discharge_capacity"), F.col("regular_cycle_number")

    def build(w):
        return {"_fade": ieee_divide(x - F.lag(x).over(w), (c - F.lag(c).over(w)).cast("double"))}

    out = ordered_columns(days, ["cell_id"], "regular_cycle_number", build, 1, tiebreak=["cycle_index"])
    return out.select("cell_id", "cycle_index", "regular_cycle_number", "discharge_capacity",
                      r6(null_infinity("_fade")).alias("discharge_capacity_fade_rate"))


# ---------------------------------------------------------------- H6


@register("unit_conversion", """
SELECT cell_id, regular_cycle_number,
  round(discharge_energy * CAST(0.001 AS DOUBLE), 6) AS discharge_energy_kwh,
  round(discharge_energy * CAST(3600 AS DOUBLE), 6) AS discharge_energy_j,
  round(discharge_capacity * CAST(1000 AS DOUBLE), 6) AS discharge_capacity_mah,
  round(discharge_capacity * CAST(3600 AS DOUBLE), 6) AS discharge_capacity_c
FROM cycles""")
def unit_conversion(spark, sf):
    """H6 for columns with a fixed unit (Wh, Ah)."""
    cyc = fx.cycles(spark, sf)
    return cyc.select(
        "cell_id", "regular_cycle_number",
        r6(units.convert("discharge_energy", "Wh", "kWh")).alias("discharge_energy_kwh"),
        r6(units.convert("discharge_energy", "Wh", "J")).alias("discharge_energy_j"),
        r6(units.convert("discharge_capacity", "Ah", "mAh")).alias("discharge_capacity_mah"),
        r6(units.convert("discharge_capacity", "Ah", "C")).alias("discharge_capacity_c"),
    )


# ---------------------------------------------------------------- H8
@register("time_bins", """
, b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)
, k AS (SELECT event_id, ts, lo, CAST(ceil((epoch_us(ts) - lo) / 3600000000.0) AS BIGINT) - 1 AS k,
               CAST(floor((hi - lo) / 3600000000.0) AS BIGINT) AS nb FROM events, b)
SELECT event_id, ts,
       CASE WHEN k >= 0 AND k < nb THEN make_timestamp(lo + k * 3600000000) END AS bin_start,
       CASE WHEN k >= 0 AND k < nb THEN make_timestamp(lo + (k + 1) * 3600000000) END AS bin_end
FROM k""")
def time_bins(spark, sf):
    """H8: hourly right-closed bins anchored at the first event."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    return timebins.time_bins(ev, "ts", "1h")
