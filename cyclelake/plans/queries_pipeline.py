"""Series and pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators.enrich import join_metadata
from ..sources import fixtures as fx
from . import pipeline as PL
from . import series as SR
from .catalog import register
from .queries_cells import rounded
from .sqlgen import dbl, nearest_quantiles_cte


# ---------------------------------------------------------------- B20, B21
@register("series_capacity", "SELECT cell_id, regular_cycle_number, round(discharge_capacity, 6) AS discharge_capacity "
                             "FROM cycles")
def series_capacity(spark, sf):
    return rounded(SR.series(fx.cycles(spark, sf), SR.PRESETS["capacity_retention"]))


@register("series_efficiency", """
SELECT cell_id, regular_cycle_number, round(coulombic_efficiency, 6) AS coulombic_efficiency,
       coalesce(coulombic_efficiency BETWEEN 95 AND 100, false) AS in_view
FROM cycles""")
def series_efficiency(spark, sf):
    return rounded(SR.series(fx.cycles(spark, sf), SR.PRESETS["efficiency"]))


@register("series_specific", """
SELECT y.cell_id, y.regular_cycle_number,
       round(CASE WHEN m.total_active_mass_g > 0 THEN 1000 * y.discharge_capacity / m.total_active_mass_g END, 6)
         AS discharge_capacity_specific_mAh_g
FROM cycles y LEFT JOIN cells m USING (cell_id)""")
def series_specific(spark, sf):
    df = join_metadata(fx.cycles(spark, sf), fx.cells(spark, sf), ["total_active_mass_g"])
    df = FT.specific_metrics(df, capacity_cols=["discharge_capacity"], energy_cols=[])
    return rounded(SR.series(df, SR.PRESETS["specific_capacity"]))


@register("series_dual", "SELECT cell_id, regular_cycle_number, round(discharge_capacity, 6) AS discharge_capacity, "
                         "round(coulombic_efficiency, 6) AS coulombic_efficiency FROM cycles")
def series_dual(spark, sf):
    return rounded(SR.series(fx.cycles(spark, sf), SR.PRESETS["dual_axis_capacity_efficiency"]))


# ---------------------------------------------------------------- J1, E20
_CAPS = ["discharge_capacity", "charge_capacity"]
_NORMED = [*_CAPS, "discharge_energy", "voltage"]
_RAW = ["test_date", *_NORMED, "temperature", "coulombic_efficiency"]
_META = ["cell_name", "design_name", "experiment_group", "layer_types", "test_status", "test_year", "total_active_mass_g",
         "nominal_capacity_ah"]


def _features_sql(by_cell: bool) -> str:
    """Every column of the feature table: statistics per cell, or over the whole table with per-cell windows."""
    key = "cell_id" if by_cell else "g"
    kept = ("SELECT 0 AS g, * FROM cycles WHERE cell_id IN (SELECT cell_id FROM cycles GROUP BY cell_id HAVING count(*) >= 20)"
            if by_cell else "SELECT 0 AS g, * FROM cycles")
    order = "regular_cycle_number" if by_cell else "cell_id * 1000000 + regular_cycle_number"
    stats = [f"stddev_samp({c}) AS {c}_sd, arg_min({c}, CASE WHEN {c} IS NOT NULL THEN {order} END) AS {c}_first" for c in _NORMED]
    stats += [f"max({c}) AS {c}_max, arg_min({c}, CASE WHEN regular_cycle_number = 1 AND ({c} IS NOT NULL OR {not by_cell}) "
              f"THEN {order} END) AS {c}_c1" for c in _CAPS]
    eol = [f"min(CASE WHEN {c} < {dbl(0.8)} * {c}_c1 THEN regular_cycle_number END) AS {c}_eol" for c in _CAPS]
    out = ["cell_id", "regular_cycle_number", "test_date", *[f"round(y.{c}, 6) AS {c}" for c in _RAW[1:]]]
    for c in _CAPS:
        out.append(f"round((y.{c} - lag(y.{c}) OVER w) / nullif(CAST(y.regular_cycle_number - lag(y.regular_cycle_number) "
                   f"OVER w AS DOUBLE), 0), 6) AS {c}_fade_rate")
        for n in (5, 10, 20):
            for name, fn in (("mean", "avg"), ("std", "stddev_samp")):
                out.append(f"round(CASE WHEN count(y.{c}) OVER w{n} = {n} THEN {fn}(y.{c}) OVER w{n} END, 6) AS {c}_rolling_{name}_{n}")
        out.append(f"round(CASE WHEN s.{c}_max <> 0 THEN y.{c} / s.{c}_max END, 6) AS {c}_efficiency")
        out.append(f"round(CASE WHEN s.{c}_c1 > 0 THEN y.{c} / s.{c}_c1 END, 6) AS {c}_retention")
        out.append(f"round(CASE WHEN s.{c}_c1 > 0 THEN s.{c}_c1 - y.{c} END, 6) AS {c}_cumulative_loss")
        out.append(f"CASE WHEN s.{c}_c1 > 0 AND s.n > 1 THEN e.{c}_eol END AS {c}_cycles_to_80pct")
        fence = f"{dbl(3.0)} * (q.{c}_p75 - q.{c}_p25)"
        out.append(f"(y.{c} < q.{c}_p25 - {fence} OR y.{c} > q.{c}_p75 + {fence}) AS {c}_outlier")
    for c in _NORMED:
        for name, base in (("first_cycle", f"s.{c}_first"), ("percentile_95", f"q.{c}_p95")):
            out.append(f"round(CASE WHEN s.{c}_sd > 0 AND {base} > 0 THEN y.{c} / {base} END, 6) AS {c}_norm_{name}")
    out += ["CAST(floor((epoch_us(y.test_date) - epoch_us(t.t0)) / 86400000000.0) AS BIGINT) AS cycle_age_days",
            "y.regular_cycle_number AS cumulative_cycles"]
    if by_cell:
        out += [f"round(m.{c}, 6) AS {c}" if c.endswith(("_g", "_ah")) else f"m.{c}" for c in _META]
    frames = ", ".join(f"w{n} AS (PARTITION BY y.cell_id ORDER BY y.regular_cycle_number ROWS BETWEEN {n - 1} PRECEDING "
                       "AND CURRENT ROW)" for n in (5, 10, 20))
    return f"""
, kept AS ({kept})
, s AS (SELECT {key}, count(*) AS n, {", ".join(stats)} FROM kept GROUP BY {key})
, t AS (SELECT cell_id, min(test_date) AS t0 FROM kept GROUP BY cell_id)
""" + nearest_quantiles_cte("q", "kept", _NORMED, [0.25, 0.75, 0.95], key=key) + f"""
, e AS (SELECT {key}, {", ".join(eol)} FROM kept JOIN s USING ({key}) GROUP BY {key})
SELECT {", ".join(out)}
FROM kept y JOIN s USING ({key}) JOIN q USING ({key}) JOIN e USING ({key}) JOIN t USING (cell_id)
{"LEFT JOIN cells m USING (cell_id)" if by_cell else ""}
WINDOW w AS (PARTITION BY y.cell_id ORDER BY y.regular_cycle_number), {frames}
"""


@register("pipeline_features", _features_sql(True))
def pipeline_features(spark, sf):
    """J1 with the default configuration: every column of the per-cell feature table."""
    return rounded(PL.process_cycle_data(fx.cycles(spark, sf), fx.cells(spark, sf)))


@register("pipeline_global", _features_sql(False))
def pipeline_global(spark, sf):
    """Statistics over the whole table instead of per cell (fade rate, rolling and age stay per cell)."""
    return rounded(PL.process_cycle_data(fx.cycles(spark, sf), None, group_by_cell=False))


# ---------------------------------------------------------------- J4, J5
_SELECTED = ["discharge_capacity", "charge_capacity", "discharge_energy"]


def _selected_sql() -> str:
    """Every column of the selected cells' cycles."""
    first = ", ".join(f"max(CASE WHEN regular_cycle_number = 1 THEN {c} END) AS {c}_c1" for c in _SELECTED)
    out = ["y.cell_id", "y.regular_cycle_number", "y.test_date", *[f"round(y.{c}, 6) AS {c}" for c in _RAW[1:]]]
    for c in _SELECTED:
        out.append(f"round(CASE WHEN c1.{c}_c1 > 0 THEN y.{c} / c1.{c}_c1 END, 6) AS {c}_norm_reg")
        out.append(f"round(CASE WHEN q.{c}_p95 > 0 THEN y.{c} / q.{c}_p95 END, 6) AS {c}_norm_p95")
        unit, scale = ("Wh", "") if c.endswith("energy") else ("mAh", "1000 * ")
        out.append(f"round(CASE WHEN m.total_active_mass_g > 0 THEN {scale}y.{c} / m.total_active_mass_g END, 6) "
                   f"AS {c}_specific_{unit}_g")
    out += [f"round(m.{c}, 6) AS {c}" if c.endswith(("_g", "_ah")) else f"m.{c}" for c in _META]
    return f"""
, sel AS (SELECT * FROM cells WHERE test_status = 'active' AND test_year = 2020)
, kept AS (SELECT * FROM cycles WHERE cell_id IN (SELECT cell_id FROM sel))
, c1 AS (SELECT cell_id, {first} FROM kept GROUP BY cell_id)
""" + nearest_quantiles_cte("q", "kept", _SELECTED, [0.95]) + f"""
SELECT {", ".join(out)}
FROM kept y LEFT JOIN c1 USING (cell_id) LEFT JOIN q USING (cell_id) LEFT JOIN sel m USING (cell_id)
"""


@register("pipeline_selected_cells", _selected_sql())
def pipeline_selected_cells(spark, sf):
    """The cells a selection picks → their cycles, loader normalisations, metadata, specific metrics."""
    cells = fx.cells(spark, sf)
    chosen = cells.filter((F.col("test_status") == "active") & (F.col("test_year") == 2020)).select("cell_id")
    return rounded(PL.selected_cells_cycles(cells, fx.cycles(spark, sf), chosen))
