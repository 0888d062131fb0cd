"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cellrules
from ..operators import quality as Q
from ..operators import sequence as SEQ
from ..operators import summary as SM
from ..sources import fixtures as fx
from .catalog import register
from .queries_cells import rounded

RESULT_COLS = ["rule_id", "rule_name", "severity", "passed", "error_count", "failed_rows"]

CYCLE_COLS = fx.CYCLE_COLUMNS


# ---------------------------------------------------------------- SQL text of the rule results
def _row(i, name, sev, passed, err, failed):
    return (f"SELECT {i} AS rule_id, '{name}' AS rule_name, '{sev}' AS severity, ({passed}) AS passed, "
            f"CAST({err} AS BIGINT) AS error_count, CAST({failed} AS BIGINT) AS failed_rows")


def _issues_sql(checks):
    """checks: list of (count_sql, present_sql given n)."""
    if not checks:
        return "true", "0", "0"
    present = [p.replace("{n}", f"({n})") for n, p in checks]
    n_issues = " + ".join(f"(CASE WHEN {p} THEN 1 ELSE 0 END)" for p in present)
    failed = " + ".join(f"(CASE WHEN {p} THEN {n} ELSE 0 END)" for (n, _), p in zip(checks, present))
    return f"({n_issues}) = 0", n_issues, failed


def _family_sql(table, cols, kind):
    checks = []
    for c in cols:
        cnt = lambda cond: f"(SELECT count(*) FROM {table} WHERE {cond})"
        nn = cnt(f"{c} IS NOT NULL")
        if kind == "capacity":
            checks += [(cnt(f"{c} < 0"), "{n} > 0"), (cnt(f"{c} > 1000"), "{n} > 0"),
                       (cnt(f"{c} = 0"), "{n} > 0 AND {n} > " + nn + " * 0.1")]
        elif kind == "energy":
            checks += [(cnt(f"{c} < 0"), "{n} > 0"), (cnt(f"{c} > 10000"), "{n} > 0")]
        elif kind == "voltage":
            checks += [(cnt(f"{c} < 1.0"), "{n} > 0"), (cnt(f"{c} > 5.0"), "{n} > 0")]
        elif kind == "temperature":
            checks += [(cnt(f"{c} < -40.0"), "{n} > 0"), (cnt(f"{c} > 100.0"), "{n} > 0")]
        else:
            checks += [(cnt(f"{c} < 0"), "{n} > 0"), (cnt(f"{c} > 1.5"), "{n} > 0"),
                       (cnt(f"{c} = 1.0"), "{n} > 0 AND {n} > " + nn + " * 0.5")]
    return _issues_sql(checks)


def _steps_sql(table, col="regular_cycle_number"):
    return (f"(SELECT cell_id, {col} - lag({col}) OVER (PARTITION BY cell_id ORDER BY {col}) AS step "
            f"FROM {table} WHERE {col} IS NOT NULL AND cell_id IS NOT NULL)")


def _standard_sql(table, cols, strict=False, sequence=False):
    warn = "error" if strict else "warning"
    rows = [_row(0, "required:cell_id", "error", "true", 0, 0)]
    below = f"(SELECT count(*) FROM {table} WHERE cell_id < 1)"
    rows.append(_row(1, "range:cell_id", warn, f"{below} = 0", f"CASE WHEN {below} > 0 THEN 1 ELSE 0 END", below))
    nonpos = f"(SELECT count(*) FROM {table} WHERE regular_cycle_number <= 0)"
    jumps = (f"(SELECT count(*) FROM (SELECT cell_id FROM {_steps_sql(table)} GROUP BY cell_id "
             f"HAVING count(*) FILTER (WHERE step > 100) > 0))")
    n = f"(CASE WHEN {nonpos} > 0 THEN 1 ELSE 0 END + {jumps})"
    rows.append(_row(2, "cycle_numbers:regular_cycle_number", warn, f"{n} = 0", n, nonpos))
    rows.append(_row(3, "cycle_numbers:cycle_number", warn, "true", 0, 0))
    fam = {
        "capacity": [c for c in cols if "capacity" in c or "cap_" in c],
        "energy": [c for c in cols if "energy" in c],
        "voltage": [c for c in cols if "volt" in c],
        "temperature": [c for c in cols if "temp" in c],
    }
    for i, (kind, name) in enumerate([("capacity", "capacity_columns"), ("energy", "energy_columns"),
                                      ("voltage", "voltage_columns"), ("temperature", "temperature_columns")], 4):
        p, e, f = _family_sql(table, fam[kind], kind)
        rows.append(_row(i, name, warn, p, e, f))
    eff = [c for c in cols if "efficiency" in c or "coulombic" in c]
    p, e, f = _family_sql(table, eff, "efficiency")
    rows.append(_row(8, "coulombic_efficiency", "info", p, e, f))
    if sequence:
        cells = (f"(SELECT count(*) FROM (SELECT cell_id FROM {_steps_sql(table)} GROUP BY cell_id "
                 f"HAVING count(*) FILTER (WHERE step > 1) > 0))")
        missing = f"(SELECT coalesce(sum(step - 1), 0) FROM {_steps_sql(table)} WHERE step > 1)"
        rows.append(_row(9, "sequence:regular_cycle_number", warn, f"{cells} = 0", cells, missing))
    return "\nUNION ALL ".join(rows)


def _results(df):
    return df.select(*RESULT_COLS)


@register("rules_standard", "\n" + _standard_sql("cycles", CYCLE_COLS))
def rules_standard(spark, sf):
    """I7 + I14 on the cycle table: one row per rule."""
    return _results(Q.validate_battery_data(fx.cycles(spark, sf)))


@register("rules_strict_report", ", r AS (" + _standard_sql("cycles", CYCLE_COLS, strict=True) + """)
SELECT CAST(count(*) AS BIGINT) AS total_rules, CAST(count(*) FILTER (WHERE passed) AS BIGINT) AS passed_validations,
  CAST(count(*) FILTER (WHERE NOT passed) AS BIGINT) AS failed_validations,
  CAST(count(*) FILTER (WHERE NOT passed AND severity = 'warning') AS BIGINT) AS warnings,
  CAST(count(*) FILTER (WHERE NOT passed AND severity = 'error') AS BIGINT) AS errors,
  round(greatest(0.0, 1.0 - (count(*) FILTER (WHERE NOT passed AND severity = 'error')
        + 0.5 * count(*) FILTER (WHERE NOT passed AND severity = 'warning')) / count(*)), 6) AS quality_score,
  count(*) FILTER (WHERE NOT passed AND severity = 'error') = 0 AS is_valid,
  list_sort(coalesce(list(rule_name) FILTER (WHERE NOT passed AND severity = 'error'), [])) AS critical_failures
FROM r""")
def rules_strict_report(spark, sf):
    """I15 + I16: the report of the strict standard run."""
    return rounded(Q.report(Q.validate_battery_data(fx.cycles(spark, sf), strict_mode=True)))


_CELL_SQL = "\nUNION ALL ".join([
    _row(0, "required:cell_id", "error", "true", 0, 0),
    _row(1, "required:cell_name", "error", "true", 0, 0),
    _row(2, "unique:cell_id", "error", "(SELECT count(cell_id) - count(DISTINCT cell_id) FROM cells_rollup) = 0",
         "(SELECT count(cell_id) - count(DISTINCT cell_id) FROM cells_rollup)",
         "(SELECT count(cell_id) - count(DISTINCT cell_id) FROM cells_rollup)"),
] + [
    _row(i, f"range:{c}", "warning",
         f"(SELECT count(*) FROM cells_rollup WHERE {c} < {lo} OR {c} > {hi}) = 0",
         f"(SELECT (CASE WHEN count(*) FILTER (WHERE {c} < {lo}) > 0 THEN 1 ELSE 0 END) + "
         f"(CASE WHEN count(*) FILTER (WHERE {c} > {hi}) > 0 THEN 1 ELSE 0 END) FROM cells_rollup)",
         f"(SELECT count(*) FROM cells_rollup WHERE {c} < {lo} OR {c} > {hi})")
    for i, (c, lo, hi) in enumerate([("total_active_mass_g", 0.001, 100.0),
                                     ("nominal_capacity_ah", 0.001, 1000.0)], 3)
])


@register("rules_cells", "\n" + _CELL_SQL)
def rules_cells(spark, sf):
    """The cell-metadata rule set."""
    cells = fx.cells_rollup(spark, sf)
    return _results(Q.validate(cells, Q.cell_metadata_rules(cells)))


@register("rules_cycles", "\n" + _standard_sql("cycles_by_day", CYCLE_COLS, sequence=True))
def rules_cycles(spark, sf):
    """I18 on day-numbered cycles, where jumps and gaps occur."""
    days = fx.cycles_by_day(spark, sf).drop("cycle_index")
    return _results(Q.validate(days, Q.cycle_data_rules(days)))


@register("cycle_jumps", f"""
SELECT cell_id, CAST(count(*) FILTER (WHERE step > 100) AS BIGINT) AS large_gaps, max(step) AS max_step
FROM {_steps_sql('cycles_by_day')} GROUP BY cell_id HAVING count(*) FILTER (WHERE step > 100) > 0""")
def cycle_jumps(spark, sf):
    """E21 + I8 per cell: steps over 100 between consecutive cycle numbers."""
    return SEQ.cycle_jumps(fx.cycles_by_day(spark, sf))


@register("missing_cycles", f"""
SELECT cell_id, prev + 1 AS gap_start, cyc - 1 AS gap_end, cyc - prev - 1 AS missing_count FROM (
  SELECT cell_id, regular_cycle_number AS cyc,
         lag(regular_cycle_number) OVER (PARTITION BY cell_id ORDER BY regular_cycle_number) AS prev
  FROM cycles_by_day) WHERE cyc - prev > 1""")
def missing_cycles(spark, sf):
    """G3 + I19: runs of missing cycle numbers per cell."""
    return SEQ.missing_cycles(fx.cycles_by_day(spark, sf))


def _list_sql(conds):
    """The non-NULL values of ``CASE ... END`` items as a list, without lambdas."""
    items = [c.replace(" THEN '", " THEN ['").replace("' END", "'] ELSE CAST([] AS VARCHAR[]) END") for c in conds]
    return "flatten([" + ", ".join(items) + "])"


_TYPES = {"cell_id": "bigint", "regular_cycle_number": "bigint", "test_date": "timestamp_ntz"}


@register("quick_check", f"""
, s AS (SELECT count(*) AS rows, {', '.join(f'count(*) - count({c}) AS n_{c}' for c in CYCLE_COLS)},
        (SELECT count(*) FROM (SELECT DISTINCT * FROM cycles)) AS n_distinct FROM cycles)
SELECT CAST(rows AS BIGINT) AS rows, CAST({len(CYCLE_COLS)} AS BIGINT) AS columns,
  CAST(rows - n_distinct AS BIGINT) AS duplicate_rows,
  {_list_sql([f"CASE WHEN n_{c} * 2 > rows THEN '{c}' END" for c in CYCLE_COLS])} AS mostly_null_columns,
  {_list_sql([f"CASE WHEN n_{c} = rows THEN '{c}' END" for c in CYCLE_COLS])} AS all_null_columns,
  CAST([] AS VARCHAR[]) AS missing_required,
  [{', '.join(f'CAST(n_{c} AS BIGINT)' for c in CYCLE_COLS)}] AS null_counts,
  [{', '.join(f"'{_TYPES.get(c, 'double')}'" for c in CYCLE_COLS)}] AS dtypes,
  CASE WHEN rows = 0 THEN 'empty'
       WHEN len({_list_sql([f"CASE WHEN n_{c} * 2 > rows THEN '{c}' END" for c in CYCLE_COLS])}) = 0
        AND rows = n_distinct THEN 'good' ELSE 'issues_found' END AS status
FROM s""")
def quick_check(spark, sf):
    """I20."""
    return Q.quick_check(fx.cycles(spark, sf))


_NV_COLS = ["discharge_capacity", "charge_capacity", "voltage", "temperature", "test_date", "cycle_time"]
_NV_OUT = ["column_name", "data_type", "total_count", "null_count", "inf_count", "min", "max", "mean", "std", "valid",
           "outlier_count", "errors", "warnings"]


def _nv_sql(col, lo, hi):
    """One validated column: profile, bounds, IQR outliers, and the warnings that hang on its name."""
    c = f"CAST({col} AS DOUBLE)"
    fin = f"CASE WHEN NOT isinf({c}) THEN {c} END"
    named = {"discharge_capacity": ["CASE WHEN mi < 0 THEN 'negative capacity' END"],
             "coulombic_efficiency": ["CASE WHEN ma > 100 THEN 'efficiency over 100' END",
                                      "CASE WHEN mi < 0 THEN 'negative efficiency' END"],
             "voltage": ["CASE WHEN mi < 0 THEN 'negative voltage' END", "CASE WHEN ma > 5 THEN 'voltage over 5' END"],
             "temperature": ["CASE WHEN mi < -50 THEN 'temperature under -50' END",
                             "CASE WHEN ma > 100 THEN 'temperature over 100' END"]}
    named["charge_capacity"] = named["discharge_capacity"]
    errors = _list_sql(["CASE WHEN inf > 0 THEN 'infinite values' END", f"CASE WHEN mi < {lo} THEN 'below minimum' END",
                        f"CASE WHEN ma > {hi} THEN 'above maximum' END"])
    warnings = _list_sql(["CASE WHEN nulls > 0 THEN 'null values' END", "CASE WHEN n = nulls THEN 'no values' END",
                          "CASE WHEN f = 0 AND n <> nulls THEN 'no finite values' END", *named.get(col, []),
                          "CASE WHEN o > 0.1 * f THEN 'many outliers' END",
                          "CASE WHEN o > 0 AND o <= 0.1 * f THEN 'outliers' END"])
    return f"""SELECT '{col}' AS column_name, '{_TYPES.get(col, 'double')}' AS data_type, CAST(n AS BIGINT) AS total_count,
  CAST(nulls AS BIGINT) AS null_count, CAST(inf AS BIGINT) AS inf_count, round(mi, 6) AS min, round(ma, 6) AS max,
  round(me, 6) AS mean, round(sd, 6) AS std, len({errors}) = 0 AS valid, CAST(CASE WHEN f > 3 THEN o END AS BIGINT) AS outlier_count,
  {errors} AS errors, {warnings} AS warnings
FROM (SELECT count(*) AS n, count(*) - count({c}) AS nulls, count(*) FILTER (WHERE isinf({c})) AS inf, count({fin}) AS f,
  min({fin}) AS mi, max({fin}) AS ma, avg({fin}) AS me, stddev_pop({fin}) AS sd,
  (SELECT count(*) FILTER (WHERE {fin} < q1 - 1.5 * (q3 - q1) OR {fin} > q3 + 1.5 * (q3 - q1)) FROM cycles,
    (SELECT quantile_cont({fin}, 0.25) AS q1, quantile_cont({fin}, 0.75) AS q3 FROM cycles)) AS o FROM cycles)"""


def _unusable_sql(col, data_type, error):
    none = "CAST(NULL AS BIGINT)"
    return (f"SELECT '{col}', {data_type}, {none}, {none}, {none}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
            f"CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), false, {none}, ['{error}'], CAST([] AS VARCHAR[])")


@register("numeric_validation", "\n" + "\nUNION ALL ".join(
    [_nv_sql(c, 0.0, 100.0) for c in _NV_COLS[:4]] + [_unusable_sql("test_date", "'timestamp_ntz'", "not numeric"),
                                                      _unusable_sql("cycle_time", "CAST(NULL AS VARCHAR)", "missing")]))
def numeric_validation(spark, sf):
    """I22 with bounds 0..100 and IQR outlier counts, over numeric, non-numeric and missing columns."""
    out = Q.numeric_validation(fx.cycles(spark, sf), _NV_COLS, min_value=0.0, max_value=100.0,
                               check_outliers=True)
    return rounded(out.select(*_NV_OUT))


_CDV = [(c, lo, hi) for c, (lo, hi) in Q.CYCLE_DATA_BOUNDS.items() if c in CYCLE_COLS]


@register("cycle_data_validation", "\n, v AS (" + "\nUNION ALL ".join(_nv_sql(c, float(lo), float(hi)) for c, lo, hi in _CDV) + """)
, r AS (SELECT avg(charge_capacity / CASE WHEN discharge_capacity <> 0 THEN discharge_capacity END) AS ratio FROM cycles)
SELECT v.*, (SELECT bool_and(valid) FROM v) AS all_valid, round(ratio, 6) AS charge_discharge_ratio,
  coalesce(ratio < 0.95, false) AS low_ratio FROM v, r""")
def cycle_data_validation(spark, sf):
    """The known cycle columns with their fixed bounds, overall validity and the charge/discharge ratio."""
    out = Q.cycle_data_validation(fx.cycles(spark, sf))
    return rounded(out.select(*_NV_OUT, "all_valid", "charge_discharge_ratio", "low_ratio"))


_PATTERNS = [("cell_name", "^[a-z]+ [a-z]+$"), ("design_name", "^Brand#[0-9]+$"), ("notes", "x")]


@register("pattern_rule", "\n" + "\nUNION ALL ".join(
    _row(i, f"pattern:{c}", "error",
         f"(SELECT count(*) FROM cells WHERE NOT regexp_matches(CAST({c} AS VARCHAR), '{p}')) = 0",
         f"(SELECT count(*) FROM cells WHERE NOT regexp_matches(CAST({c} AS VARCHAR), '{p}'))",
         f"(SELECT count(*) FROM cells WHERE NOT regexp_matches(CAST({c} AS VARCHAR), '{p}'))")
    if c != "notes" else _row(i, f"pattern:{c}", "error", "false", 0, 0)
    for i, (c, p) in enumerate(_PATTERNS)))
def pattern_rule(spark, sf):
    """I5 (and a missing column, which fails)."""
    return _results(Q.validate(fx.cells(spark, sf), [Q.pattern_check(c, p) for c, p in _PATTERNS]))


@register("unique_ids", """
SELECT CAST(count(cell_id) AS BIGINT) AS n_ids, CAST(count(DISTINCT cell_id) AS BIGINT) AS n_unique,
       CAST(count(cell_id) - count(DISTINCT cell_id) AS BIGINT) AS duplicate_ids,
       count(cell_id) = count(DISTINCT cell_id) AS passed
FROM cycles""")
def unique_ids(spark, sf):
    """D10/I3 on the cycle table's cell ids (many rows per cell, so duplicates)."""
    return SM.unique_ids(fx.cycles(spark, sf))


@register("custom_rule", "\n" + "\nUNION ALL ".join([
    _row(0, "charge_covers_discharge", "warning",
         "(SELECT count(*) FROM cycles WHERE NOT coalesce(charge_capacity >= discharge_capacity * 0.9, false)) = 0",
         "(SELECT count(*) FROM cycles WHERE NOT coalesce(charge_capacity >= discharge_capacity * 0.9, false))",
         "(SELECT count(*) FROM cycles WHERE NOT coalesce(charge_capacity >= discharge_capacity * 0.9, false))"),
    _row(1, "max_temperature_below_120", "error", "(SELECT max(temperature) < 120 FROM cycles)",
         "(SELECT CASE WHEN max(temperature) < 120 THEN 0 ELSE 1 END FROM cycles)", 0),
    _row(2, "bad_return", "error", "false", 0, 0),
]))
def custom_rule(spark, sf):
    """K1: a row predicate, an aggregate predicate, and a rule whose function returns the wrong type."""
    rules = [
        Q.custom("charge_capacity", lambda df: F.col("charge_capacity") >= F.col("discharge_capacity") * 0.9,
                 Q.WARNING, "charge_covers_discharge"),
        Q.custom("temperature", lambda df: F.max("temperature") < 120, name="max_temperature_below_120"),
        Q.custom("x", lambda df: 42, name="bad_return"),
    ]
    return _results(Q.validate(fx.cycles(spark, sf), rules))


_BIN = "least(greatest(floor(discharge_capacity / 5), 0), 9)"


@register("cell_variety_rule", f"""
, bins AS (SELECT cell_id, {_BIN} AS bin, count(*) AS n FROM cycles WHERE discharge_capacity IS NOT NULL GROUP BY cell_id, bin)
, totals AS (SELECT cell_id, sum(n) AS total FROM bins GROUP BY cell_id)
, verdicts AS (SELECT cell_id, -sum(n / total * log2(n / total)) AS entropy, max(total) AS total, count(*) AS bins
  FROM bins JOIN totals USING (cell_id) GROUP BY cell_id)
SELECT cell_id, 'value_variety' AS rule, coalesce(entropy >= 2.47, false) AS is_valid,
  concat(CAST(coalesce(total, 0) AS BIGINT), ' values in ', coalesce(bins, 0), ' bins') AS details
FROM (SELECT DISTINCT cell_id FROM cycles) c LEFT JOIN verdicts USING (cell_id)
""")
def cell_variety_rule(spark, sf):
    """K1 (b): a per-cell rule in Python, as mergeable states: the entropy of each cell's capacity histogram."""
    return cellrules.check_cells(fx.cycles(spark, sf), cellrules.variety_rule("discharge_capacity", 5.0, 10, 2.47))
