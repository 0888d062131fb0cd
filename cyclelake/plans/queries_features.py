"""Per-cell feature queries (E1-E19, H3-H5) over the derived cycle table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import features as FT
from ..operators.enrich import join_metadata
from ..sources import fixtures as fx
from .catalog import register
from .sqlgen import dbl, nearest_quantiles_cte

KEY = ["cell_id", "regular_cycle_number"]
CAPS = ["charge_capacity", "discharge_capacity"]
NORMS = ["charge_capacity", "discharge_capacity", "discharge_energy", "voltage"]


def _select(df: DataFrame, inputs: list[str], outputs: list[str], extra: list[str] = ()) -> DataFrame:
    """Keys, inputs, then outputs with doubles rounded to 6 places."""
    cols = [F.col(c) for c in KEY + list(extra) + list(inputs)]
    for c in outputs:
        dt = df.schema[c].dataType.typeName()
        cols.append(r6(c).alias(c) if dt in ("double", "float") else F.col(c))
    return df.select(*cols)


def _features(spark: SparkSession, sf: str, spec: FT.FeatureSpec) -> DataFrame:
    return FT.cycle_features(fx.cycles(spark, sf), spec)


# ---------------------------------------------------------------- flagship: E12 + C1
def capacity_retention(spark: SparkSession, sf: str) -> DataFrame:
    cyc = fx.cycles(spark, sf)
    first = cyc.groupBy("cell_id").agg(
        F.max(F.when(F.col("regular_cycle_number") == 1, F.col("discharge_capacity"))).alias("_c1"))
    c1 = F.col("_c1")
    out = cyc.join(first, "cell_id", "left").withColumn(
        "discharge_capacity_retention", F.when(c1 > 0, F.col("discharge_capacity") / c1))
    out = join_metadata(out, fx.cells(spark, sf), ["cell_name"])
    return out.select("cell_id", "cell_name", "regular_cycle_number", "discharge_capacity",
                      r6("discharge_capacity_retention").alias("discharge_capacity_retention"))


register("capacity_retention", """
, c1 AS (SELECT cell_id, max(CASE WHEN regular_cycle_number = 1 THEN discharge_capacity END) AS c1
         FROM cycles GROUP BY cell_id)
SELECT y.cell_id, m.cell_name, y.regular_cycle_number, y.discharge_capacity,
       round(CASE WHEN c1.c1 > 0 THEN y.discharge_capacity / c1.c1 END, 6) AS discharge_capacity_retention
FROM cycles y LEFT JOIN c1 USING (cell_id) LEFT JOIN cells m USING (cell_id)
""")(capacity_retention)


# ---------------------------------------------------------------- E1-E3
@register("cycle_age", """
SELECT cell_id, regular_cycle_number, test_date,
       CAST(floor((epoch_us(test_date) - epoch_us(min(test_date) OVER (PARTITION BY cell_id)))
                  / 86400000000.0) AS BIGINT) AS cycle_age_days,
       regular_cycle_number AS cumulative_cycles
FROM cycles
""")
def cycle_age(spark, sf):
    df = _features(spark, sf, FT.FeatureSpec(cycle=True))
    return _select(df, ["test_date"], ["cycle_age_days", "cumulative_cycles"])


@register("capacity_efficiency", """
SELECT cell_id, regular_cycle_number, charge_capacity, discharge_capacity,
  round(CASE WHEN max(charge_capacity) OVER c <> 0 THEN charge_capacity / max(charge_capacity) OVER c END, 6)
    AS charge_capacity_efficiency,
  round(CASE WHEN max(discharge_capacity) OVER c <> 0 THEN discharge_capacity / max(discharge_capacity) OVER c END, 6)
    AS discharge_capacity_efficiency
FROM cycles WINDOW c AS (PARTITION BY cell_id)
""")
def capacity_efficiency(spark, sf):
    df = _features(spark, sf, FT.FeatureSpec(cycle=True))
    return _select(df, CAPS, [f"{c}_efficiency" for c in CAPS])


# ---------------------------------------------------------------- E4-E9
def _norm_parts(method: str) -> list[str]:
    parts = []
    for c in NORMS:
        std_ok = f"s.{c}_std > 0"
        if method == "first_cycle":
            e = f"CASE WHEN {std_ok} AND s.{c}_first > 0 THEN y.{c} / s.{c}_first END"
        elif method == "max_value":
            e = f"CASE WHEN {std_ok} AND s.{c}_max > 0 THEN y.{c} / s.{c}_max END"
        elif method in ("percentile_95", "percentile_99"):
            p = "p95" if method.endswith("95") else "p99"
            e = f"CASE WHEN {std_ok} AND q.{c}_{p} > 0 THEN y.{c} / q.{c}_{p} END"
        elif method == "z_score":
            e = f"CASE WHEN {std_ok} THEN (y.{c} - s.{c}_mean) / s.{c}_std END"
        else:
            e = (f"CASE WHEN {std_ok} AND s.{c}_max > s.{c}_min THEN "
                 f"(y.{c} - s.{c}_min) / (s.{c}_max - s.{c}_min) END")
        parts.append(f"round({e}, 6) AS {c}_norm_{method}")
    return parts


def _norm_stats(order: str) -> str:
    return ", ".join(
        f"max({c}) AS {c}_max, min({c}) AS {c}_min, avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, "
        f"arg_min({c}, CASE WHEN {c} IS NOT NULL THEN {order} END) AS {c}_first"
        for c in NORMS)


def _norm_sql(method: str) -> str:
    parts, stats = _norm_parts(method), _norm_stats("regular_cycle_number")
    qcte = ""
    qjoin = ""
    if method.startswith("percentile"):
        q = 0.95 if method.endswith("95") else 0.99
        qcte = nearest_quantiles_cte("q", "cycles", NORMS, [q])
        qjoin = "LEFT JOIN q USING (cell_id)"
    return (f", s AS (SELECT cell_id, {stats} FROM cycles GROUP BY cell_id){qcte}\n"
            f"SELECT y.cell_id, y.regular_cycle_number, {', '.join('y.' + c for c in NORMS)}, "
            f"{', '.join(parts)} FROM cycles y LEFT JOIN s USING (cell_id) {qjoin}")


def _norm_query(method: str):
    def build(spark, sf):
        df = _features(spark, sf, FT.FeatureSpec(normalise=(method,)))
        return _select(df, NORMS, [f"{c}_norm_{method}" for c in NORMS])
    return build


for _name, _method in [("norm_first_cycle", "first_cycle"), ("norm_max", "max_value"),
                       ("norm_p95", "percentile_95"), ("norm_p99", "percentile_99"),
                       ("norm_zscore", "z_score"), ("norm_minmax", "min_max")]:
    register(_name, _norm_sql(_method))(_norm_query(_method))


@register("norms_global", f"""
, whole AS (SELECT 0 AS g, * FROM cycles)
, s AS (SELECT g, {_norm_stats("cell_id * 1000000 + regular_cycle_number")} FROM whole GROUP BY g)
""" + nearest_quantiles_cte("q", "whole", NORMS, [0.95, 0.99], key="g") + f"""
SELECT y.cell_id, y.regular_cycle_number, {", ".join(f"y.{c}" for c in NORMS)},
  {", ".join(p for m in FT.NORM_METHODS for p in _norm_parts(m))} FROM whole y JOIN s USING (g) JOIN q USING (g)""")
def norms_global(spark, sf):
    """E20 with all six normalisations: statistics of the whole table."""
    df = FT.cycle_features(fx.cycles(spark, sf), FT.FeatureSpec(normalise=FT.NORM_METHODS), by_cell=False)
    return _select(df, NORMS, [f"{c}_norm_{m}" for m in FT.NORM_METHODS for c in NORMS])


# ---------------------------------------------------------------- E10-E11
BASICS = ["charge_capacity", "discharge_capacity", "discharge_energy"]


@register("norm_reg", nearest_quantiles_cte("q", "cycles", BASICS, [0.95]) + """
, c1 AS (SELECT cell_id, """ + ", ".join(
    f"max(CASE WHEN regular_cycle_number = 1 THEN {c} END) AS {c}_c1" for c in BASICS) + """
         FROM cycles GROUP BY cell_id)
SELECT y.cell_id, y.regular_cycle_number, """ + ", ".join(f"y.{c}" for c in BASICS) + ", " + ", ".join(
    f"round(CASE WHEN c1.{c}_c1 > 0 THEN y.{c} / c1.{c}_c1 END, 6) AS {c}_norm_reg, "
    f"round(CASE WHEN q.{c}_p95 > 0 THEN y.{c} / q.{c}_p95 END, 6) AS {c}_norm_p95" for c in BASICS) + """
FROM cycles y LEFT JOIN c1 USING (cell_id) LEFT JOIN q USING (cell_id)
""")
def norm_reg(spark, sf):
    df = _features(spark, sf, FT.FeatureSpec(basic_norm=True))
    outs = [x for c in BASICS for x in (f"{c}_norm_reg", f"{c}_norm_p95")]
    return _select(df, BASICS, outs)


# ---------------------------------------------------------------- E12-E15
_C1 = ", c1 AS (SELECT cell_id, count(*) AS n_rows, " + ", ".join(
    f"max(CASE WHEN regular_cycle_number = 1 THEN {c} END) AS {c}_c1" for c in CAPS) + \
    " FROM cycles GROUP BY cell_id)"


@register("fade_rate", """
SELECT cell_id, regular_cycle_number, charge_capacity, discharge_capacity, """ + ", ".join(
    f"round((({c} - lag({c}) OVER w) / nullif(CAST(regular_cycle_number - lag(regular_cycle_number) OVER w "
    f"AS DOUBLE), 0)), 6) AS {c}_fade_rate" for c in CAPS) + """
FROM cycles WINDOW w AS (PARTITION BY cell_id ORDER BY regular_cycle_number)
""")
def fade_rate(spark, sf):
    df = _features(spark, sf, FT.FeatureSpec(degrade=True))
    return _select(df, CAPS, [f"{c}_fade_rate" for c in CAPS])


@register("cumulative_loss", _C1 + """
SELECT y.cell_id, y.regular_cycle_number, y.charge_capacity, y.discharge_capacity, """ + ", ".join(
    f"round(CASE WHEN c1.{c}_c1 > 0 THEN y.{c} / c1.{c}_c1 END, 6) AS {c}_retention, "
    f"round(CASE WHEN c1.{c}_c1 > 0 THEN c1.{c}_c1 - y.{c} END, 6) AS {c}_cumulative_loss" for c in CAPS) + """
FROM cycles y LEFT JOIN c1 USING (cell_id)
""")
def cumulative_loss(spark, sf):
    df = _features(spark, sf, FT.FeatureSpec(degrade=True))
    outs = [x for c in CAPS for x in (f"{c}_retention", f"{c}_cumulative_loss")]
    return _select(df, CAPS, outs)


@register("cycles_to_80pct", _C1 + """
, eol AS (SELECT y.cell_id, """ + ", ".join(
    f"min(CASE WHEN y.{c} < {dbl(0.8)} * c1.{c}_c1 THEN y.regular_cycle_number END) AS {c}_eol" for c in CAPS) + """
          FROM cycles y JOIN c1 USING (cell_id) GROUP BY y.cell_id)
SELECT c1.cell_id, """ + ", ".join(
    f"CASE WHEN c1.{c}_c1 > 0 AND c1.n_rows > 1 THEN eol.{c}_eol END AS {c}_cycles_to_80pct" for c in CAPS) + """
FROM c1 JOIN eol USING (cell_id)
""")
def cycles_to_80pct(spark, sf):
    """E15 as a per-cell table (the feature repeats this value on every row of a cell)."""
    return FT.cycles_to_80pct(fx.cycles(spark, sf), CAPS)


# ---------------------------------------------------------------- E16-E18
def _rolling_sql(n: int) -> str:
    parts = []
    for c in CAPS:
        parts.append(f"round(CASE WHEN count({c}) OVER w = {n} THEN avg({c}) OVER w END, 6) AS {c}_rolling_mean_{n}")
        parts.append(f"round(CASE WHEN count({c}) OVER w = {n} THEN stddev_samp({c}) OVER w END, 6) "
                     f"AS {c}_rolling_std_{n}")
    return (f"SELECT cell_id, regular_cycle_number, charge_capacity, discharge_capacity, {', '.join(parts)} "
            f"FROM cycles WINDOW w AS (PARTITION BY cell_id ORDER BY regular_cycle_number "
            f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")


def _rolling_query(n: int):
    def build(spark, sf):
        df = _features(spark, sf, FT.FeatureSpec(rolling=True, rolling_windows=(n,)))
        outs = [x for c in CAPS for x in (f"{c}_rolling_mean_{n}", f"{c}_rolling_std_{n}")]
        return _select(df, CAPS, outs)
    return build


for _n in FT.ROLLING_WINDOWS:
    register(f"rolling_stats_{_n}", _rolling_sql(_n))(_rolling_query(_n))


@register("temperature_features", """
SELECT cell_id, regular_cycle_number, temperature,
  round(CASE WHEN count(temperature) OVER w = 5 THEN avg(temperature) OVER w END, 6) AS temperature_rolling_5,
  round(CASE WHEN count(temperature) OVER w = 5 THEN stddev_samp(temperature) OVER w END, 6) AS temperature_std_5,
  round(temperature - avg(temperature) OVER (PARTITION BY cell_id), 6) AS temperature_deviation
FROM cycles WINDOW w AS (PARTITION BY cell_id ORDER BY regular_cycle_number ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""")
def temperature_features(spark, sf):
    df = _features(spark, sf, FT.FeatureSpec(temperature=True))
    return _select(df, ["temperature"], ["temperature_rolling_5", "temperature_std_5", "temperature_deviation"])


# ---------------------------------------------------------------- H3-H5
@register("specific_metrics", """
SELECT y.cell_id, y.regular_cycle_number, m.total_active_mass_g,
  round(CASE WHEN m.total_active_mass_g > 0 THEN 1000 * y.charge_capacity / m.total_active_mass_g END, 6)
    AS charge_capacity_specific_mAh_g,
  round(CASE WHEN m.total_active_mass_g > 0 THEN 1000 * y.discharge_capacity / m.total_active_mass_g END, 6)
    AS discharge_capacity_specific_mAh_g,
  round(CASE WHEN m.total_active_mass_g > 0 THEN y.discharge_energy / m.total_active_mass_g END, 6)
    AS discharge_energy_specific_Wh_g
FROM cycles y LEFT JOIN cells m USING (cell_id)
""")
def specific_metrics(spark, sf):
    cyc = fx.cycles(spark, sf)
    df = join_metadata(cyc, fx.cells(spark, sf), ["total_active_mass_g"])
    df = FT.specific_metrics(df, capacity_cols=CAPS, energy_cols=["discharge_energy"])
    outs = ["charge_capacity_specific_mAh_g", "discharge_capacity_specific_mAh_g", "discharge_energy_specific_Wh_g"]
    return _select(df, ["total_active_mass_g"], outs)


@register("coulombic_efficiency", """
SELECT cell_id, regular_cycle_number, charge_capacity, discharge_capacity,
  round(CASE WHEN charge_capacity <> 0 THEN discharge_capacity / charge_capacity ELSE 0.0 END, 6)
    AS coulombic_efficiency_charge_capacity_discharge_capacity
FROM cycles
""")
def coulombic_efficiency(spark, sf):
    df = FT.coulombic_efficiency(fx.cycles(spark, sf))
    return _select(df, CAPS, ["coulombic_efficiency_charge_capacity_discharge_capacity"])


# ---------------------------------------------------------------- E19, D13
_IQR3 = nearest_quantiles_cte("q", "cycles", CAPS, [0.25, 0.75]) + """
, flagged AS (
  SELECT y.cell_id, y.regular_cycle_number, y.charge_capacity, y.discharge_capacity, """ + ", ".join(
    f"(y.{c} < q.{c}_p25 - {dbl(3.0)} * (q.{c}_p75 - q.{c}_p25) OR "
    f"y.{c} > q.{c}_p75 + {dbl(3.0)} * (q.{c}_p75 - q.{c}_p25)) AS {c}_outlier" for c in CAPS) + """
  FROM cycles y LEFT JOIN q USING (cell_id))
"""


@register("outliers_iqr3_per_cell", _IQR3 + "SELECT cell_id, regular_cycle_number, charge_capacity, discharge_capacity, "
          "charge_capacity_outlier, discharge_capacity_outlier FROM flagged")
def outliers_iqr3_per_cell(spark, sf):
    df = _features(spark, sf, FT.FeatureSpec(outliers=True))
    return _select(df, CAPS, [f"{c}_outlier" for c in CAPS])


@register("outlier_counts", _IQR3 + "SELECT " + ", ".join(
    f"CAST(sum(CASE WHEN {c}_outlier THEN 1 ELSE 0 END) AS BIGINT) AS {c}_outliers" for c in CAPS) + " FROM flagged")
def outlier_counts(spark, sf):
    """Number of flagged rows per capacity column."""
    df = _features(spark, sf, FT.FeatureSpec(outliers=True))
    return df.agg(*[F.sum(F.when(F.col(f"{c}_outlier"), 1).otherwise(0)).cast("long").alias(f"{c}_outliers")
                    for c in CAPS])
