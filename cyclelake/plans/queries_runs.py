"""Rule details (I14), the rows of a full run (J3, I15), merged profiles (D4, D6), and
rows of options that the other queries leave out (B20, F2, I22)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import predicates as P
from ..operators import profiles as PR
from ..operators import quality as Q
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from . import pipeline as PL
from . import series as SR
from .catalog import register
from .queries_cells import rounded
from .queries_quality import CYCLE_COLS, RESULT_COLS, _standard_sql, _steps_sql

# per family: the columns' name parts, and (condition, share of the non-null rows it must exceed, text) of each issue
_FAMILIES = {
    "capacity": (("capacity", "cap_"), [("< 0", 0, "rows < 0"), ("> 1000", 0, "rows > 1000"), ("= 0", 0.1, "rows = 0")]),
    "energy": (("energy",), [("< 0", 0, "rows < 0"), ("> 10000", 0, "rows > 10000")]),
    "voltage": (("volt",), [("< 1.0", 0, "rows < 1.0 V"), ("> 5.0", 0, "rows > 5.0 V")]),
    "temperature": (("temp",), [("< -40.0", 0, "rows < -40.0 °C"), ("> 100.0", 0, "rows > 100.0 °C")]),
    "efficiency": (("efficiency", "coulombic"), [("< 0", 0, "rows < 0"), ("> 1.5", 0, "rows > 1.5"), ("= 1.0", 0.5, "rows = 1")]),
}


def _joined(items: list[str], otherwise: str) -> str:
    return f"coalesce(nullif(concat_ws('; ', {', '.join(items)}), ''), '{otherwise}')"


def _details_sql(table: str, cols: list[str]) -> str:
    """What the standard rules say, one row per rule."""
    count = lambda condition: f"(SELECT count(*) FROM {table} WHERE {condition})"
    says = lambda n, text: f"CASE WHEN {n} > 0 THEN concat({n}, '{text}') END"
    jumping = f"(SELECT count(DISTINCT cell_id) FROM {_steps_sql(table)} WHERE step > 100)"
    out = ["'in the schema'", _joined([says(count("cell_id < 1"), " rows < 1")], "0 rows out of range"),
           _joined([says(count("regular_cycle_number <= 0"), " rows numbered below 1"), says(jumping, " cells jump ahead")],
                   "0 odd cycle numbers"), "'no column cycle_number'"]
    for family, (parts, issues) in _FAMILIES.items():
        found = [c for c in cols if any(p in c for p in parts)]
        texts = [f"CASE WHEN {count(f'{c} {test}')} > {share} * {count(f'{c} IS NOT NULL')} "
                 f"THEN concat('{c}: ', {count(f'{c} {test}')}, ' {text}') END" for c in found for test, share, text in issues]
        out.append(_joined(texts, "valid") if found else f"'no {family} column'")
    return "\nUNION ALL ".join(f"SELECT {i} AS rule_id, {text} AS details" for i, text in enumerate(out))


def _rules_sql(table: str, cols: list[str]) -> str:
    return (f", r AS ({_standard_sql(table, cols)})\n, notes AS ({_details_sql(table, cols)})\n"
            f"SELECT {', '.join(RESULT_COLS)}, details FROM r JOIN notes USING (rule_id)")


@register("rules_with_details", _rules_sql("cycles", CYCLE_COLS))
def rules_with_details(spark, sf):
    """The standard rules with what each says of the rows."""
    return Q.validate_battery_data(fx.cycles(spark, sf)).select(*RESULT_COLS, "details")


# ---------------------------------------------------------------- J3
_CAPS = ["discharge_capacity", "charge_capacity"]
_NORMED = [*_CAPS, "discharge_energy", "voltage"]
# the numeric columns of the run's feature table, in its order
_COLUMNS = [*CYCLE_COLS[3:], *[f"{c}_efficiency" for c in _CAPS], *[f"{c}_norm_max_value" for c in _NORMED],
            "total_active_mass_g", "nominal_capacity_ah", "last_discharge_capacity", "discharge_capacity_retention"]
_STATS = ", ".join(f"max({c}) AS {c}_max, stddev_samp({c}) AS {c}_sd" for c in _NORMED)
_RATIOS = [f"CASE WHEN s.{c}_max <> 0 THEN k.{c} / s.{c}_max END AS {c}_efficiency" for c in _CAPS]
_RATIOS += [f"CASE WHEN s.{c}_sd > 0 AND s.{c}_max > 0 THEN k.{c} / s.{c}_max END AS {c}_norm_max_value" for c in _NORMED]
_RUN_SQL = f"""
, chosen AS (SELECT * FROM cells_rollup WHERE regular_cycles > 20 AND test_status = 'active')
, picked AS (SELECT * FROM cycles WHERE cell_id IN (SELECT cell_id FROM chosen))
, kept AS (SELECT * FROM picked WHERE cell_id IN (SELECT cell_id FROM picked GROUP BY cell_id HAVING count(*) >= 30))
, s AS (SELECT cell_id, {_STATS} FROM kept GROUP BY cell_id)
, feats AS (SELECT k.*, {", ".join(_RATIOS)}, {", ".join(f"m.{c}" for c in _COLUMNS[-4:])}
  FROM kept k JOIN s USING (cell_id) JOIN chosen m USING (cell_id))
"""


def _run(spark, sf):
    config = PL.create_processing_config(["max_value"], min_cycles=30, add_degradation=False, add_rolling=False)
    cycles = fx.cycles(spark, sf)
    return PL.load_and_process(fx.cells_rollup(spark, sf, cycles), cycles, filters={"test_status": "active"}, config=config)


@register("full_run_rules", _RUN_SQL + _rules_sql("feats", _COLUMNS))
def full_run_rules(spark, sf):
    """What the rules, measured while the features were written, say of them."""
    return _run(spark, sf)["rules"].select(*RESULT_COLS, "details")


@register("full_run_report", _RUN_SQL + f", r AS ({_standard_sql('feats', _COLUMNS)})" + """
SELECT count(*) AS total_rules, count(*) FILTER (WHERE passed) AS passed_validations,
  count(*) FILTER (WHERE NOT passed) AS failed_validations, count(*) FILTER (WHERE NOT passed AND severity = 'warning') AS warnings,
  count(*) FILTER (WHERE NOT passed AND severity = 'error') AS errors,
  round(1 - (count(*) FILTER (WHERE NOT passed AND severity = 'error')
    + 0.5 * count(*) FILTER (WHERE NOT passed AND severity = 'warning')) / count(*), 6) AS quality_score,
  count(*) FILTER (WHERE NOT passed AND severity = 'error') = 0 AS is_valid,
  list_sort(coalesce(list(rule_name) FILTER (WHERE NOT passed AND severity = 'error'), [])) AS critical_failures
FROM r""")
def full_run_report(spark, sf):
    """J3 + I15: the report of a full run."""
    return rounded(_run(spark, sf)["report"])


@register("full_run_features", _RUN_SQL + f"""
SELECT cell_id, regular_cycle_number, {", ".join(f"round({c}, 6) AS {c}" for c in _COLUMNS)} FROM feats""")
def full_run_features(spark, sf):
    """The numeric columns of the feature table that a full run wrote."""
    return rounded(_run(spark, sf)["cycles"].select("cell_id", "regular_cycle_number", *map(F.col, _COLUMNS)))


# ---------------------------------------------------------------- D4, D6
@register("profile_by_file", "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count, CAST(0 AS BIGINT) AS inf_count, "
    f"round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, "
    f"round(count({c}) / count(*), 6) AS completeness FROM cycles" for c in CYCLE_COLS[3:]))
def profile_by_file(spark, sf):
    """D4 + D6 merged from one state per file of the cycle table; files that came later are read alone."""
    cycles = fx.cycles(spark, sf)
    files = sorted(cycles.inputFiles())
    path = os.path.join(checkpoint_dir(spark), f"profile-{uuid.uuid4().hex}")
    for known in (files[:len(files) // 2 + 1], files):
        PR.update_states(spark.read.schema(cycles.schema).parquet(*known), path, CYCLE_COLS[3:])
    return rounded(PR.merged_profile(spark, path, files))


# ---------------------------------------------------------------- I22, B20, F2
_CHECKED = ["discharge_capacity", "charge_capacity", "voltage", "temperature"]
_SCORES = {"zscore": "abs(({c} - (SELECT avg({c}) FROM cycles)) / (SELECT nullif(stddev_pop({c}), 0) FROM cycles)) > 3",
           "modified_zscore": "abs(0.6745 * ({c} - (SELECT median({c}) FROM cycles)) / (SELECT nullif(median(abs({c} - m)), 0) "
                              "FROM cycles, (SELECT median({c}) AS m FROM cycles))) > 3.5"}


def _scored_query(method: str):
    def build(spark, sf):
        out = Q.numeric_validation(fx.cycles(spark, sf), _CHECKED, check_outliers=True, outlier_method=method)
        return out.select("column_name", "total_count", "null_count", "outlier_count")
    return build


for _method, _test in _SCORES.items():
    register(f"numeric_validation_{_method}", "\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count, "
        f"count(*) FILTER (WHERE {_test.replace('{c}', c)}) AS outlier_count FROM cycles" for c in _CHECKED))(_scored_query(_method))


@register("series_window", """
SELECT cell_id, regular_cycle_number, round(discharge_capacity, 6) AS discharge_capacity, round(voltage, 6) AS voltage,
  coalesce(regular_cycle_number BETWEEN 5 AND 20 AND discharge_capacity BETWEEN 10 AND 40, false) AS in_view FROM cycles""")
def series_window(spark, sf):
    """Limits on both axes and a second value; rows outside the view are flagged."""
    config = SR.SeriesConfig(y2="voltage", x_min=5, x_max=20, y_min=10, y_max=40)
    return rounded(SR.series(fx.cycles(spark, sf), config))


@register("sorted_choices_all", "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY choice) AS INTEGER) AS place, choice FROM "
    f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS choice FROM cells WHERE {c} IS NOT NULL UNION SELECT '')" for c in P.FILTER_COLUMNS))
def sorted_choices_all(spark, sf):
    """F2 for every filter column."""
    return P.sorted_choices(fx.cells(spark, sf))
