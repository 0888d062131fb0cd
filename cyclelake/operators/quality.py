"""Data-quality rules (I1-I23, K1) compiled to Spark aggregates.

A rule set runs as **one** aggregate over the data (every row rule contributes ``count_if``/``min``/``max``
expressions to the same ``agg``) plus, when sequence rules are present, one sequence pass
(:func:`~cyclelake.operators.sequence.sequence_summary`). The one-row results are attached as scalar
subqueries and unpivoted into the rule-result DataFrame: one row per rule with ``passed``, ``error_count``
(what the reference counts: bounds or issues), ``failed_rows`` (rows that broke the rule) and ``details``.
The report (I15) is an aggregate over that DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import null_infinity
from . import sequence as SEQ
from . import schema as S

ERROR, WARNING, INFO = "error", "warning", "info"

# The reference's standard bounds.
CAPACITY_MAX = 1000.0
CAPACITY_ZERO_SHARE = 0.1
ENERGY_MAX = 10000.0
VOLTAGE_RANGE = (1.0, 5.0)
TEMPERATURE_RANGE = (-40.0, 100.0)
EFFICIENCY_RANGE = (0.0, 1.5)
EFFICIENCY_ONE_SHARE = 0.5
MASS_RANGE = (0.001, 100.0)
NOMINAL_CAPACITY_RANGE = (0.001, 1000.0)


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    kind: str  # required | type | range | pattern | custom | capacity | energy | voltage | temperature |
    #            efficiency | cycle_numbers | sequence | unique
    severity: str = ERROR
    params: dict = field(default_factory=dict)
    func: Callable | None = None


def required(column: str, severity: str = ERROR) -> Rule:
    return Rule(f"required:{column}", column, "required", severity)


def type_check(column: str, expected: T.DataType | Sequence[T.DataType], severity: str = ERROR) -> Rule:
    types = tuple(expected) if isinstance(expected, (list, tuple)) else (expected,)
    return Rule(f"type:{column}", column, "type", severity, {"types": types})


def range_check(column: str, min_val: float | None = None, max_val: float | None = None,
                severity: str = WARNING) -> Rule:
    return Rule(f"range:{column}", column, "range", severity, {"min": min_val, "max": max_val})


def pattern_check(column: str, pattern: str, severity: str = ERROR) -> Rule:
    return Rule(f"pattern:{column}", column, "pattern", severity, {"pattern": pattern})


def custom(column: str, func: Callable[[DataFrame], Column], severity: str = ERROR, name: str | None = None) -> Rule:
    """K1: ``func(df)`` returns a boolean Column. A row-level predicate (rows must satisfy it) or an aggregate
    predicate (e.g. ``F.max(x) < 10``); both are evaluated inside the shared aggregate."""
    return Rule(name or f"custom:{column}", column, "custom", severity, func=func)


def battery_standards() -> list[Rule]:
    """The standard battery rule set."""
    return [
        required("cell_id"),
        range_check("cell_id", min_val=1),
        Rule("cycle_numbers:regular_cycle_number", "regular_cycle_number", "cycle_numbers", WARNING),
        Rule("cycle_numbers:cycle_number", "cycle_number", "cycle_numbers", WARNING),
        Rule("capacity_columns", "capacity_columns", "capacity", WARNING, {"patterns": ("capacity", "cap_")}),
        Rule("energy_columns", "energy_columns", "energy", WARNING, {"patterns": ("energy",)}),
        Rule("voltage_columns", "voltage_columns", "voltage", WARNING, {"patterns": ("voltage", "volt")}),
        Rule("temperature_columns", "temperature_columns", "temperature", WARNING,
             {"patterns": ("temp", "temperature")}),
        Rule("coulombic_efficiency", "coulombic_efficiency", "efficiency", INFO),
    ]


def strict(rules: Sequence[Rule]) -> list[Rule]:
    """I16: warnings become errors."""
    return [replace(r, severity=ERROR) if r.severity == WARNING else r for r in rules]


def cell_metadata_rules(df: DataFrame) -> list[Rule]:
    """I17."""
    rules = [required("cell_id"), required("cell_name"), Rule("unique:cell_id", "cell_id", "unique", ERROR)]
    if "total_active_mass_g" in df.columns:
        rules.append(range_check("total_active_mass_g", *MASS_RANGE))
    if "nominal_capacity_ah" in df.columns:
        rules.append(range_check("nominal_capacity_ah", *NOMINAL_CAPACITY_RANGE))
    return rules


def cycle_data_rules(df: DataFrame) -> list[Rule]:
    """Standard rules plus the per-cell sequence rule."""
    rules = battery_standards()
    if "regular_cycle_number" in df.columns:
        rules.append(Rule("sequence:regular_cycle_number", "regular_cycle_number", "sequence", WARNING))
    return rules


# ------------------------------------------------------------------ compilation
def _cols_like(df: DataFrame, patterns: Sequence[str]) -> list[str]:
    return [c for c in df.columns if any(p.lower() in c.lower() for p in patterns)]


class _Compiler:
    """Collects aggregate expressions and, per rule, result expressions over the aggregated row."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.aggs: dict[str, Column] = {"__rows": F.count(F.lit(1))}
        self.apart: set[str] = set()  # aggregates that can't be observed metrics
        self.seq: dict[str, Column] = {}

    def agg(self, expr: Column, observable: bool = True) -> Column:
        name = f"__a{len(self.aggs)}"
        self.aggs[name] = expr
        if not observable:
            self.apart.add(name)
        return F.col(name)

    def count_if(self, pred: Column) -> Column:
        return self.agg(F.count_if(pred).cast("long"))

    def seq_value(self, column: str, field_name: str) -> Column:
        """A field of the one-row sequence summary. Every field reads the same struct-valued scalar subquery,
        so Spark runs the sequence pass once per column however many rules use it."""
        if column not in self.seq:
            summary = SEQ.sequence_summary(self.df, column)
            self.seq[column] = summary.select(F.struct(*summary.columns).alias("s")).scalar()
        return self.seq[column].getField(field_name)


def _result(passed: Column, error_count: Column, failed_rows: Column, details: Column) -> dict:
    return {"passed": passed, "error_count": error_count.cast("long"), "failed_rows": failed_rows.cast("long"),
            "details": details}


def _issue_rule(comp: _Compiler, issues: list[tuple[Column, Column, str]], empty_note: str) -> dict:
    """Rules made of per-column issues: (rows_flagged, issue_present, text)."""
    if not issues:
        return _result(F.lit(True), F.lit(0), F.lit(0), F.lit(empty_note))
    present = [F.when(p, 1).otherwise(0) for _, p, _ in issues]
    n_issues = sum(present[1:], present[0])
    failed = sum([F.when(p, n).otherwise(0) for n, p, _ in issues[1:]],
                 F.when(issues[0][1], issues[0][0]).otherwise(0))
    texts = F.concat_ws("; ", *[F.when(p, F.format_string(t, n)) for n, p, t in issues])
    return _result(n_issues == 0, n_issues, failed, F.when(n_issues == 0, F.lit("valid")).otherwise(texts))


def _compile(comp: _Compiler, rule: Rule) -> dict:
    df = comp.df
    c = rule.column
    exists = c in df.columns
    if rule.kind == "required":
        return _result(F.lit(exists), F.lit(0 if exists else 1), F.lit(0),
                       F.lit("in the schema" if exists else f"no column {c}"))
    if rule.kind == "type":
        ok = exists and isinstance(df.schema[c].dataType, tuple(type(t) for t in rule.params["types"]))
        return _result(F.lit(ok), F.lit(0 if ok else 1), F.lit(0),
                       F.lit("type matches" if ok else (f"{c} is {comp.df.schema[c].dataType.simpleString()}" if exists
                                                         else f"no column {c}")))
    if rule.kind == "range":
        if not exists:
            return _result(F.lit(False), F.lit(0), F.lit(0), F.lit(f"no column {c}"))
        if not S.is_numeric(df, c):  # the reference's comparison would raise: a raising rule fails
            return _result(F.lit(False), F.lit(0), F.lit(0), F.lit(f"{c} holds no numbers"))
        x = F.col(c)
        lo, hi = rule.params.get("min"), rule.params.get("max")
        below = comp.count_if(x < lo) if lo is not None else F.lit(0)
        above = comp.count_if(x > hi) if hi is not None else F.lit(0)
        bounds = F.when(below > 0, 1).otherwise(0) + F.when(above > 0, 1).otherwise(0)
        text = F.concat_ws("; ", F.when(below > 0, F.format_string(f"%d rows < {lo}", below)),
                           F.when(above > 0, F.format_string(f"%d rows > {hi}", above)))
        nonnull = comp.count_if(x.isNotNull())
        return _result(bounds == 0, bounds, below + above,
                       F.when(nonnull == 0, F.lit("column holds only NULLs"))
                       .when(bounds == 0, F.lit("0 rows out of range")).otherwise(text))
    if rule.kind == "pattern":
        if not exists:
            return _result(F.lit(False), F.lit(0), F.lit(0), F.lit(f"no column {c}"))
        s = F.col(c).cast("string")
        bad = comp.count_if(~s.rlike(rule.params["pattern"]))
        total = comp.agg(F.count(F.lit(1)))
        return _result(bad == 0, bad, bad, F.format_string("%d of %d rows match", total - bad, total))
    if rule.kind == "custom":
        try:
            pred = rule.func(df)
        except Exception as e:  # a rule that raises counts as failed (I14)
            return _result(F.lit(False), F.lit(0), F.lit(0), F.lit(f"rule raised {type(e).__name__}: {e}"))
        if not isinstance(pred, Column):
            return _result(F.lit(False), F.lit(0), F.lit(0),
                           F.lit(f"rule must return a Column, got {type(pred).__name__}"))
        try:  # an aggregate predicate goes in as is; a row predicate is counted
            df.agg(pred.alias("_probe")).schema
            value = comp.agg(pred, observable=False)  # it may be a distinct one
            return _result(F.coalesce(value, F.lit(False)), F.when(value, 0).otherwise(1), F.lit(0),
                           F.lit("aggregate predicate"))
        except Exception:
            pass
        try:  # a row predicate must at least resolve against the frame
            df.select(pred.alias("_probe")).schema
        except Exception as e:
            return _result(F.lit(False), F.lit(0), F.lit(0), F.lit(f"rule raised {type(e).__name__}: {e}"))
        bad = comp.count_if(~F.coalesce(pred, F.lit(False)))
        return _result(bad == 0, bad, bad, F.format_string("%d rows fail the rule", bad))
    if rule.kind == "unique":
        if not exists:
            return _result(F.lit(False), F.lit(0), F.lit(0), F.lit(f"no column {c}"))
        dup = comp.agg(F.count(c)) - comp.agg(F.count_distinct(c), observable=False)
        return _result(dup == 0, dup, dup,
                       F.when(dup == 0, F.lit("0 repeated ids")).otherwise(
                           F.format_string("%d repeated ids", dup)))
    if rule.kind in ("capacity", "energy", "voltage", "temperature", "efficiency"):
        return _column_family(comp, rule)
    if rule.kind == "cycle_numbers":
        if not exists:
            return _result(F.lit(True), F.lit(0), F.lit(0), F.lit(f"no column {c}"))
        nonpos = comp.count_if(F.col(c) <= 0)
        jumps = comp.seq_value(c, "cells_with_jumps")
        n = F.when(nonpos > 0, 1).otherwise(0) + jumps
        text = F.concat_ws("; ", F.when(nonpos > 0, F.format_string("%d rows numbered below 1", nonpos)),
                           F.when(jumps > 0, F.format_string("%d cells jump ahead", jumps)))
        return _result(n == 0, n, nonpos, F.when(n == 0, F.lit("0 odd cycle numbers")).otherwise(text))
    if rule.kind == "sequence":
        if not exists or "cell_id" not in df.columns:
            return _result(F.lit(True), F.lit(0), F.lit(0), F.lit("no cell or cycle column"))
        cells = comp.seq_value(c, "cells_with_gaps")
        missing = comp.seq_value(c, "missing_numbers")
        return _result(cells == 0, cells, missing,
                       F.when(cells == 0, F.lit("0 missing cycle numbers")).otherwise(
                           F.format_string("%d cells miss %d cycle numbers", cells, missing)))
    raise ValueError(f"Unknown validation type: {rule.kind}")


def _column_family(comp: _Compiler, rule: Rule) -> dict:
    df = comp.df
    kind = rule.kind
    issues: list[tuple[Column, Column, str]] = []
    if kind == "efficiency":
        cols = [c for c in df.columns if "efficiency" in c.lower() or "coulombic" in c.lower()]
    else:
        cols = _cols_like(df, rule.params["patterns"])
    # only measurements: a boolean flag or a text column whose name matches is not compared with numbers
    cols = [c for c in cols if S.is_numeric(df, c)]
    for c in cols:
        x = F.col(c)
        nonnull = comp.count_if(x.isNotNull())

        def add(pred: Column, text: str, extra: Column | None = None) -> None:
            n = comp.count_if(pred)
            issues.append((n, (n > 0) if extra is None else ((n > 0) & extra(n)), f"{c}: %d {text}"))

        if kind == "capacity":
            add(x < 0, "rows < 0")
            add(x > CAPACITY_MAX, f"rows > {CAPACITY_MAX:g}")
            add(x == 0, "rows = 0", lambda n, nn=nonnull: n > nn * F.lit(CAPACITY_ZERO_SHARE))
        elif kind == "energy":
            add(x < 0, "rows < 0")
            add(x > ENERGY_MAX, f"rows > {ENERGY_MAX:g}")
        elif kind == "voltage":
            add(x < VOLTAGE_RANGE[0], f"rows < {VOLTAGE_RANGE[0]} V")
            add(x > VOLTAGE_RANGE[1], f"rows > {VOLTAGE_RANGE[1]} V")
        elif kind == "temperature":
            add(x < TEMPERATURE_RANGE[0], f"rows < {TEMPERATURE_RANGE[0]} °C")
            add(x > TEMPERATURE_RANGE[1], f"rows > {TEMPERATURE_RANGE[1]} °C")
        else:
            add(x < EFFICIENCY_RANGE[0], "rows < 0")
            add(x > EFFICIENCY_RANGE[1], f"rows > {EFFICIENCY_RANGE[1]}")
            add(x == 1.0, "rows = 1", lambda n, nn=nonnull: n > nn * F.lit(EFFICIENCY_ONE_SHARE))
    return _issue_rule(comp, issues, f"no {kind} column")


RESULT_SCHEMA = ("rule_id", "rule_name", "column_name", "rule_type", "severity", "passed", "error_count",
                 "failed_rows", "details")


def _compiled(df: DataFrame, rules: Sequence[Rule]) -> tuple[_Compiler, list[tuple[int, Rule, dict]]]:
    comp = _Compiler(df)
    return comp, [(i, r, _compile(comp, r)) for i, r in enumerate(rules)]


def _rule_rows(wide: DataFrame, compiled: list[tuple[int, Rule, dict]]) -> DataFrame:
    """The row of aggregates as one row per rule; none for an empty frame."""
    structs = [F.struct(F.lit(i).alias("rule_id"), F.lit(r.name).alias("rule_name"),
                        F.lit(r.column).alias("column_name"), F.lit(r.kind).alias("rule_type"),
                        F.lit(r.severity).alias("severity"), res["passed"].alias("passed"),
                        res["error_count"].alias("error_count"), res["failed_rows"].alias("failed_rows"),
                        res["details"].cast("string").alias("details"))
               for i, r, res in compiled]
    return wide.filter(F.col("__rows") > 0).select(F.inline(F.array(*structs)))


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule. An empty frame gives no rows (its report scores 1.0)."""
    comp, compiled = _compiled(df, rules)
    return _rule_rows(df.agg(*[e.alias(n) for n, e in comp.aggs.items()]), compiled)


def validate_while_writing(df: DataFrame, rules: Sequence[Rule], path: str) -> DataFrame:
    """Write ``df`` to ``path`` (parquet) and return what :func:`validate` says of it, without reading it again.

    The rules' aggregates are observed metrics of the write. Only what a metric can't be is taken from the written table:
    distinct counts and custom aggregate predicates in one pass, cycle-number sequences in a pass over cell and number.
    """
    first, _ = _compiled(df, rules)
    metrics = Observation()
    df.observe(metrics, *[e.alias(n) for n, e in first.aggs.items() if n not in first.apart]).write.parquet(path)
    seen = metrics.get
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if "__rows" not in seen:  # an empty input may leave no metrics
        return validate(back, rules)
    comp, compiled = _compiled(back, rules)
    apart = [e.alias(n) for n, e in comp.aggs.items() if n in comp.apart]
    wide = back.agg(*apart) if apart else df.sparkSession.range(1).select()
    types = df.agg(*[e.alias(n) for n, e in first.aggs.items()]).schema
    return _rule_rows(wide.select("*", *[F.lit(v).cast(types[n].dataType).alias(n) for n, v in seen.items()]), compiled)


def report(results: DataFrame) -> DataFrame:
    """Counts, quality score = max(0, 1 − (errors + 0.5·warnings) ÷ rules), validity, critical failures."""
    failed = ~F.col("passed")
    n = F.count(F.lit(1))
    errors = F.count_if(failed & (F.col("severity") == ERROR))
    warnings = F.count_if(failed & (F.col("severity") == WARNING))
    agg = results.agg(
        n.cast("long").alias("total_rules"),
        F.count_if(F.col("passed")).cast("long").alias("passed_validations"),
        F.count_if(failed).cast("long").alias("failed_validations"),
        warnings.cast("long").alias("warnings"),
        errors.cast("long").alias("errors"),
        F.when(n > 0, F.greatest(F.lit(0.0), F.lit(1.0) - (errors + F.lit(0.5) * warnings) / n))
        .otherwise(F.lit(1.0)).alias("quality_score"),
        (errors == 0).alias("is_valid"),
        F.sort_array(F.collect_list(F.when(failed & (F.col("severity") == ERROR), F.col("rule_name"))))
        .alias("critical_failures"),
    )
    return agg


def validate_battery_data(df: DataFrame, strict_mode: bool = False) -> DataFrame:
    """I16."""
    rules = battery_standards()
    return validate(df, strict(rules) if strict_mode else rules)


# ------------------------------------------------------------------ I20, I22, I23
def quick_check(df: DataFrame, required_cols: Sequence[str] = ("cell_id",)) -> DataFrame:
    """One row with rows, columns, duplicate rows, columns over 50 % null, all-null columns, missing
    required columns, null counts and data types in column order, and a status
    (good / issues_found / empty). Two jobs: one aggregate, one distinct count."""
    n = F.count(F.lit(1))
    nulls = {c: F.sum(F.col(c).isNull().cast("long")) for c in df.columns}
    n_distinct = df.distinct().agg(F.count(F.lit(1))).scalar()
    wide = df.agg(n.alias("rows"), *[v.alias(f"__n_{i}") for i, v in enumerate(nulls.values())])
    names = list(nulls)
    over_half = F.filter(F.array(*[F.when(F.col(f"__n_{i}") * 2 > F.col("rows"), F.lit(c))
                                   for i, c in enumerate(names)]), lambda x: x.isNotNull())
    all_null = F.filter(F.array(*[F.when(F.col(f"__n_{i}") == F.col("rows"), F.lit(c))
                                  for i, c in enumerate(names)]), lambda x: x.isNotNull())
    missing = [c for c in required_cols if c not in df.columns]
    out = wide.select(
        F.col("rows").cast("long").alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        (F.col("rows") - n_distinct).cast("long").alias("duplicate_rows"),
        over_half.alias("mostly_null_columns"),
        all_null.alias("all_null_columns"),
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_required"),
        F.array(*[F.coalesce(F.col(f"__n_{i}"), F.lit(0)) for i in range(len(names))]).cast("array<bigint>").alias("null_counts"),
        F.array(*[F.lit(df.schema[c].dataType.simpleString()) for c in names]).cast("array<string>").alias("dtypes"),
    )
    n_issues = (F.size("mostly_null_columns") + F.size("all_null_columns")
                + F.when(F.col("duplicate_rows") > 0, 1).otherwise(0) + F.size("missing_required"))
    return out.withColumn("status", F.when(F.col("rows") == 0, F.lit("empty"))
                          .when(n_issues == 0, F.lit("good")).otherwise(F.lit("issues_found")))


# Per-column bounds of the cycle-data validation.
CYCLE_DATA_BOUNDS = {
    "discharge_capacity": (0, 10),
    "charge_capacity": (0, 10),
    "coulombic_efficiency": (0, 101),
    "cell_voltage": (0, 5),
    "temperature": (-50, 100),
    "regular_cycle_number": (0, 10000),
    "cycle_time": (0, None),
    "energy": (0, 50),
    "resistance": (0, 1000),
}


# The checks that hang on a column's name: (names, statistic, limit, is an upper limit, warning).
NAMED_CHECKS = [
    (("discharge_capacity", "charge_capacity", "capacity"), "min", 0.0, False, "negative capacity"),
    (("coulombic_efficiency", "efficiency"), "max", 100.0, True, "efficiency over 100"),
    (("coulombic_efficiency", "efficiency"), "min", 0.0, False, "negative efficiency"),
    (("voltage", "cell_voltage"), "min", 0.0, False, "negative voltage"),
    (("voltage", "cell_voltage"), "max", 5.0, True, "voltage over 5"),
    (("temperature",), "min", -50.0, False, "temperature under -50"),
    (("temperature",), "max", 100.0, True, "temperature over 100"),
]
MANY_OUTLIERS = 0.1


def _outlier_counts(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    """(column_name, outlier_count) over finite values: one row of statistics and one count for all columns.

    The modified z-score needs the medians before the deviations' medians; that one row comes to the driver (literals keep the
    second plan free of nested subqueries, which Spark's subquery merging can't place).
    """
    from .ordering import quantiles
    from .outliers import IQR_FACTOR, MODIFIED_Z_LIMIT, MODIFIED_Z_SCALE, ZSCORE_LIMIT

    finite = df.select(*[null_infinity(F.col(c).cast("double")).alias(c) for c in columns])
    flags = {}
    if method == "iqr":
        stats = quantiles(finite, [], columns, [0.25, 0.75], "linear")
        for c in columns:
            q1, q3 = F.col(f"{c}_p25"), F.col(f"{c}_p75")
            margin = F.lit(IQR_FACTOR) * (q3 - q1)
            flags[c] = (F.col(c) < q1 - margin) | (F.col(c) > q3 + margin)
    elif method == "zscore":
        stats = finite.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
        flags = {c: F.abs(F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std"))) > ZSCORE_LIMIT for c in columns}
    elif method == "modified_zscore":
        medians = quantiles(finite, [], columns, [0.5], "linear").first()
        off = {c: F.col(c) - F.lit(medians[f"{c}_p50"]).cast("double") for c in columns}
        stats = quantiles(finite.select(*[F.abs(d).alias(c) for c, d in off.items()]), [], columns, [0.5], "linear")
        flags = {c: F.abs(F.try_divide(F.lit(MODIFIED_Z_SCALE) * d, F.col(f"{c}_p50"))) > MODIFIED_Z_LIMIT for c, d in off.items()}
    else:
        raise ValueError(f"Unknown outlier detection method: {method}")
    # without keys the table of statistics is one row
    wide = finite.join(F.broadcast(stats), F.lit(True)).agg(*[F.count_if(x).cast("long").alias(c) for c, x in flags.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("outlier_count")) for c in columns])))


def _present(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def numeric_validation(df: DataFrame, columns: Sequence[str], allow_null: bool = True,
                       min_value: float | None = None, max_value: float | None = None,
                       check_infinite: bool = True, check_outliers: bool = False, outlier_method: str = "iqr",
                       bounds: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """One row per asked column: data type, profile (D6), ``errors`` and ``warnings`` as arrays of short texts,
    ``valid`` (no errors), and ``outlier_count`` when ``check_outliers`` and more than 3 finite values.

    A missing or non-numeric column gives an invalid row with no figures. ``bounds`` sets (minimum, maximum) by
    column and goes before ``min_value`` and ``max_value``.
    """
    from .summary import column_profile

    numeric = [c for c in columns if c in df.columns and S.is_numeric(df, c)]
    limit = {c: (bounds or {}).get(c, (min_value, max_value)) for c in numeric}
    name = F.col("column_name")
    unusable = df.sparkSession.createDataFrame(
        [(c, df.schema[c].dataType.simpleString() if c in df.columns else None,
          ["not numeric" if c in df.columns else "missing"]) for c in columns if c not in numeric],
        "column_name string, data_type string, errors array<string>")
    unusable = unusable.withColumns({"warnings": F.array().cast("array<string>"), "valid": F.lit(False)})
    if not numeric:
        return unusable
    finite = F.col("total_count") - F.col("null_count") - F.col("inf_count")

    def broken(side: int) -> Column:
        stat = F.col("max" if side else "min")
        tests = [(stat > v[side]) if side else (stat < v[side]) for v in limit.values() if v[side] is not None]
        which = [c for c, v in limit.items() if v[side] is not None]
        return reduce(lambda a, b: a | b, [(name == c) & t for c, t in zip(which, tests)], F.lit(False))

    out = column_profile(df, numeric)
    types = F.create_map(*[F.lit(x) for c in numeric for x in (c, df.schema[c].dataType.simpleString())])
    nulls = F.col("null_count") > 0
    errors = [F.when(F.lit(not allow_null) & nulls, F.lit("null values")),
              F.when(F.lit(check_infinite) & (F.col("inf_count") > 0), F.lit("infinite values")),
              F.when(broken(0), F.lit("below minimum")), F.when(broken(1), F.lit("above maximum"))]
    warnings = [F.when(F.lit(allow_null) & nulls, F.lit("null values")),
                F.when(F.col("total_count") == F.col("null_count"), F.lit("no values")).when(
                    finite == 0, F.lit("no finite values"))]
    warnings += [F.when(F.lower(name).isin(list(names)) & ((F.col(stat) > v) if upper else (F.col(stat) < v)), F.lit(text))
                 for names, stat, v, upper, text in NAMED_CHECKS]
    if check_outliers:
        out = out.join(_outlier_counts(df, numeric, outlier_method), "column_name", "left").withColumn(
            "outlier_count", F.when(finite > 3, F.col("outlier_count")))
        share = F.col("outlier_count") / finite
        warnings.append(F.when(share > MANY_OUTLIERS, F.lit("many outliers")).when(share > 0, F.lit("outliers")))
    out = out.withColumns({"data_type": F.element_at(types, name), "errors": _present(errors), "warnings": _present(warnings)})
    return out.withColumn("valid", F.size("errors") == 0).unionByName(unusable, allowMissingColumns=True)


def cycle_data_validation(df: DataFrame, check_outliers: bool = True) -> DataFrame:
    """The known columns with their bounds (IQR outlier counts as in the reference), one row each, in one pass;
    ``all_valid`` over all of them, the mean charge/discharge ratio (D14) and whether it is low."""
    from .summary import LOW_CHARGE_DISCHARGE_RATIO, charge_discharge_ratio

    known = [c for c in CYCLE_DATA_BOUNDS if c in df.columns]
    out = numeric_validation(df, known, bounds=CYCLE_DATA_BOUNDS, check_outliers=check_outliers)
    out = out.withColumn("all_valid", F.min("valid").over(Window.partitionBy()))  # one row per known column
    ratio = F.lit(None).cast("double")
    if {"charge_capacity", "discharge_capacity"} <= set(df.columns):
        ratio = charge_discharge_ratio(df).select("charge_discharge_ratio").scalar()
    return out.withColumn("charge_discharge_ratio", ratio).withColumn(
        "low_ratio", F.coalesce(F.col("charge_discharge_ratio") < LOW_CHARGE_DISCHARGE_RATIO, F.lit(False)))
