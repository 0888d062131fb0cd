"""Queries over the remaining surface: projections, names, stacking, choices, units, schema and full runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import units
from ..operators import features as FT
from ..operators import predicates as P
from ..operators import quality as Q
from ..operators import schema as S
from ..operators.enrich import join_metadata
from ..sources import fixtures as fx
from ..sources import tables as TB
from . import pipeline as PL
from .catalog import register
from .queries_cells import CELLS_SELECT, CELL_COLS, CYCLE_COLS, _sql_cols, rounded
from .queries_quality import _results, _row


@register("display_projection", "SELECT cell_id, cell_name, test_year FROM cells_rollup")
def display_projection(spark, sf):
    """The id first, then the chosen columns once each; unknown ones are left out."""
    return P.display_columns(fx.cells_rollup(spark, sf), ["cell_name", "cell_id", "test_year", "cell_name", "gone"])


@register("base_projection", f"SELECT {_sql_cols(CYCLE_COLS)}, round(total_active_mass_g, 6) AS total_active_mass_g "
                             "FROM cycles LEFT JOIN (SELECT cell_id, total_active_mass_g FROM cells) USING (cell_id)")
def base_projection(spark, sf):
    """The specific metrics that H3/H4 added are removed again."""
    cyc = join_metadata(fx.cycles(spark, sf), fx.cells(spark, sf), ["total_active_mass_g"])
    return rounded(P.base_projection(FT.specific_metrics(cyc)))


_AXES = {"numeric": ["discharge_capacity", "cell_id", "regular_cycle_number", "charge_capacity", "discharge_energy", "voltage",
                     "temperature", "coulombic_efficiency"], "grouping": ["cell_id"]}


@register("axis_columns", "\n" + "\nUNION ALL ".join(
    f"SELECT '{role}' AS role, CAST({i} AS INTEGER) AS place, '{c}' AS column_name, count({c}) AS n FROM cycles"
    for role, names in _AXES.items() for i, c in enumerate(names)))
def axis_columns(spark, sf):
    """Columns for axes (a preferred one first) and for grouping, with their numbers of values."""
    cyc = fx.cycles(spark, sf)
    found = S.axis_columns(cyc, preferred=["gone", "discharge_capacity"])
    counts = cyc.agg(*[F.count(c).alias(c) for c in sorted({c for v in found.values() for c in v})])
    rows = [F.struct(F.lit(role).alias("role"), F.lit(i).alias("place"), F.lit(c).alias("column_name"), F.col(c).alias("n"))
            for role, names in found.items() for i, c in enumerate(names)]
    return counts.select(F.inline(F.array(*rows)))


_SPELT = ["cellId", "Regular Cycle-Number", "test date", "dischargeCapacity", "Charge-Capacity", "discharge  Energy", "Voltage",
          "Temperature", "coulombic_Efficiency"]


@register("snake_case_columns", f"SELECT {_sql_cols(CYCLE_COLS)} FROM cycles")
def snake_case_columns(spark, sf):
    """Spelt-out names become snake case."""
    return rounded(S.normalise_column_names(fx.cycles(spark, sf).toDF(*_SPELT)))


@register("sorted_cycles", f"SELECT {_sql_cols(CYCLE_COLS)} FROM cycles ORDER BY cell_id, regular_cycle_number")
def sorted_cycles(spark, sf):
    """F1."""
    return rounded(TB.sorted_cycles(fx.cycles(spark, sf)))


@register("sorted_filter_choices", "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY choice) AS INTEGER) AS place, choice FROM "
    f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS choice FROM cells WHERE {c} IS NOT NULL UNION SELECT '')"
    for c in ("test_status", "layer_types")))
def sorted_filter_choices(spark, sf):
    """each column's choices in text order, the empty one first."""
    return P.sorted_choices(fx.cells(spark, sf), ["test_status", "layer_types"])


@register("stacked_frames", f"""
SELECT {_sql_cols(CYCLE_COLS)}, CAST(NULL AS BIGINT) AS batch FROM cycles WHERE cell_id % 2 = 0
UNION ALL SELECT cell_id, regular_cycle_number, test_date,
  round(discharge_capacity, 6), round(charge_capacity, 6), round(discharge_energy, 6), round(voltage, 6),
  CAST(NULL AS DOUBLE), round(coulombic_efficiency, 6), CAST(7 AS BIGINT) FROM cycles WHERE cell_id % 2 = 1""")
def stacked_frames(spark, sf):
    """G1: frames with different columns are stacked by name, absent columns are NULL."""
    cyc = fx.cycles(spark, sf)
    odd = cyc.filter("cell_id % 2 = 1").drop("temperature").withColumn("batch", F.lit(7).cast("long"))
    return rounded(TB.stack([cyc.filter("cell_id % 2 = 0"), odd]))


@register("type_rules", "\n" + "\nUNION ALL ".join([
    _row(0, "type:cell_id", "error", "true", 0, 0), _row(1, "type:voltage", "error", "false", 1, 0),
    _row(2, "type:gone", "error", "false", 1, 0)]))
def type_rules(spark, sf):
    """One type or a list of them; a missing column fails."""
    rules = [Q.type_check("cell_id", [T.LongType(), T.IntegerType()]), Q.type_check("voltage", [T.StringType()]),
             Q.type_check("gone", [T.DoubleType()])]
    return _results(Q.validate(fx.cycles(spark, sf), rules))


@register("schema_report", """
SELECT false AS valid, ['missing required columns: gone'] AS errors, CAST([] AS VARCHAR[]) AS warnings,
  CAST(9 AS INTEGER) AS columns, CAST(2 AS INTEGER) AS required_present, CAST(1 AS INTEGER) AS optional_present,
  count(*) AS rows FROM cycles""")
def schema_report(spark, sf):
    """I21 as a one-row table."""
    return S.schema_report(fx.cycles(spark, sf), ["cell_id", "voltage", "gone"], ["temperature", "elsewhere"])


@register("units_per_row", """
SELECT cell_id, regular_cycle_number, round(discharge_energy * CASE cell_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0
  WHEN 2 THEN 0.001 END, 6) AS energy_wh FROM cycles""")
def units_per_row(spark, sf):
    """H6 with a unit in each row; rows whose label could mean several units give NULL."""
    label = F.element_at(F.array(*[F.lit(u) for u in ("Wh", "KWH", "mWh", "MWH")]), (F.col("cell_id") % 4 + 1).cast("int"))
    cyc = fx.cycles(spark, sf).withColumn("unit", label)
    return rounded(units.convert_by_unit_column(cyc, "discharge_energy", "unit", "Wh", "energy_wh", strict=False).select(
        "cell_id", "regular_cycle_number", "energy_wh"))


@register("cells_search_substring", CELLS_SELECT + " WHERE contains(lower(test_status), 'acti')")
def cells_search_substring(spark, sf):
    """``=`` with a value that is no number looks for the text."""
    return rounded(P.apply_search(fx.cells_rollup(spark, sf), "test_status:=ACTI")[0].select(*CELL_COLS))


@register("cycles_for_id_list", f"SELECT {_sql_cols(CYCLE_COLS)} FROM cycles WHERE cell_id IN (3, 5, 8, 13, 21, 34, 55, 89)")
def cycles_for_id_list(spark, sf):
    """A list of ids becomes a predicate that is pushed to the scan."""
    return rounded(TB.cycles_for_cells(fx.cycles(spark, sf), [3, 5, 8, 13, 21, 34, 55, 89]))


@register("configured_pipeline", """
, kept AS (SELECT * FROM cycles WHERE cell_id IN (SELECT cell_id FROM cycles GROUP BY cell_id HAVING count(*) >= 30))
, s AS (SELECT cell_id, max(voltage) AS vmax, stddev_samp(voltage) AS vstd, max(discharge_capacity) AS dmax FROM kept GROUP BY cell_id)
SELECT k.cell_id, k.regular_cycle_number, round(CASE WHEN s.vstd > 0 AND s.vmax > 0 THEN k.voltage / s.vmax END, 6)
  AS voltage_norm_max_value, round(CASE WHEN s.dmax <> 0 THEN k.discharge_capacity / s.dmax END, 6)
  AS discharge_capacity_efficiency FROM kept k JOIN s USING (cell_id)""")
def configured_pipeline(spark, sf):
    """Chosen switches and methods; unknown method names are skipped."""
    config = PL.create_processing_config(["max_value", "gone"], min_cycles=30, add_degradation=False, add_rolling=False)
    out = PL.process_cycle_data(fx.cycles(spark, sf), None, config)
    if any("rolling" in c or "retention" in c for c in out.columns):
        raise ValueError("switched-off features were built")
    return rounded(out.select("cell_id", "regular_cycle_number", "voltage_norm_max_value", "discharge_capacity_efficiency"))


@register("full_run", """
, chosen AS (SELECT cell_id FROM cells_rollup WHERE regular_cycles > 20 AND test_status = 'active')
, kept AS (SELECT * FROM cycles JOIN chosen USING (cell_id))
SELECT 'cells' AS frame, (SELECT count(*) FROM chosen) AS rows, CAST(13 AS INTEGER) AS columns
UNION ALL SELECT 'cycles', count(*), CAST(54 AS INTEGER) FROM kept
UNION ALL SELECT 'rules', CAST(9 AS BIGINT), CAST(9 AS INTEGER)""")
def full_run(spark, sf):
    """Cells by filter, their cycles with all features, the rules over them, and the counts of each."""
    cyc = fx.cycles(spark, sf)
    return PL.load_and_process(fx.cells_rollup(spark, sf, cyc), cyc, filters={"test_status": "active"})["counts"]
