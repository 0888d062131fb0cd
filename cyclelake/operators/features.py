"""Per-cell cycle features (E1-E19) and specific metrics (H3-H5), skew-safe.

Plan shape, whatever features are asked for:

* **Per-cell statistics** (max, min, mean, sample std, first non-null value in cycle order, value at cycle 1,
  first test date) come from one ``groupBy("cell_id")`` with map-side partial aggregation, so a hot cell is
  combined inside every task before anything is shuffled. Exact quantiles (E6, E7, E11, E19) come from
  :func:`~cyclelake.operators.ordering.quantiles`. The per-cell tables have one row per cell and are joined back on
  ``cell_id`` by :class:`~cyclelake.operators.skew.HotKeys`: a plain join (AQE broadcasts a small table) unless a cell is over
  the threshold; hot cells' rows are then dealt to parts of about that many rows.
* **Order-dependent features** (E13 ``lag``, E16-E18 row frames) split cells by size: cells up
  to ``hot_rows`` rows use one window over the cell (bounded partitions, one shuffle); larger cells use
  windows over ``(cell_id, chunk)`` with a halo of look-back rows
  (:func:`~cyclelake.operators.ordering.with_chunks`), so no task ever holds a whole hot cell.

Output schemas never depend on values (SURVEY §1): where the reference leaves a column out (reference value
not > 0, std not > 0, no cycle 1, nothing under 80 %), the column is present and NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch_micros, ratio, safe_divide
from . import schema as S
from .ordering import hot_group_rows, ordered_columns, q_name, quantiles
from .skew import HotKeys, hot_keys, matched

CELL = "cell_id"
CYCLE = "regular_cycle_number"

# Normalisation method names, rolling window sizes, thresholds (reference defaults).
NORM_METHODS = ("first_cycle", "max_value", "percentile_95", "percentile_99", "z_score", "min_max")
DEFAULT_NORM_METHODS = ("first_cycle", "percentile_95")
ROLLING_WINDOWS = (5, 10, 20)
TEMPERATURE_WINDOW = 5
EOL_FRACTION = 0.8
OUTLIER_FACTOR = 3.0
MIN_CYCLES = 20


@dataclass(frozen=True)
class FeatureSpec:
    """Which feature groups to build; column lists default to name/type discovery on the input schema."""

    cycle: bool = False            # E1-E3
    normalise: Sequence[str] = ()  # E4-E9 method names
    basic_norm: bool = False       # E10-E11
    degrade: bool = False          # E12-E15
    rolling: bool = False          # E16-E17
    temperature: bool = False      # E18
    outliers: bool = False         # E19
    outlier_factor: float = OUTLIER_FACTOR
    rolling_windows: Sequence[int] = ROLLING_WINDOWS
    min_cycles: int | None = None  # B14 applied on the result: cells with fewer rows are dropped
    hot_rows: int | None = None    # cells larger than this take the skew-safe (split) paths; None: session conf
    chunk_rows: int | None = None  # window partition size on the split path; None: session conf


def _st(c: str, what: str) -> str:
    return f"_{c}__{what}"


def _keys(key: str | None) -> list[str]:
    return [key] if key else []


def cell_stats(cycles: DataFrame, cols: Sequence[str], first_date: bool = False, key: str | None = CELL) -> DataFrame:
    """One row per cell: max, min, mean, sample std, first non-null (by cycle), value at cycle 1.

    Without ``key``, one row of the whole table: "first" follows (cell_id, cycle) order and the cycle-1 value is that of the
    lowest cell id, as in a table sorted by cell and cycle.
    """
    cyc = F.col(CYCLE) if key == CELL else F.struct(F.col(CELL), F.col(CYCLE))
    at_one = F.when(F.col(CYCLE) == 1, cyc)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.max(x).alias(_st(c, "max")),
            F.min(x).alias(_st(c, "min")),
            F.avg(x).alias(_st(c, "mean")),
            F.stddev_samp(x).alias(_st(c, "std")),
            F.min_by(x, F.when(x.isNotNull(), cyc)).alias(_st(c, "first")),
            (F.max(F.when(F.col(CYCLE) == 1, x)) if key == CELL else F.min_by(x, at_one)).alias(_st(c, "c1")),
        ]
    if first_date:
        aggs.append(F.min("test_date").alias("_first_test_date"))
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    return cycles.groupBy(*_keys(key)).agg(*aggs)


def _quantile_table(cycles: DataFrame, wanted: dict[str, set[float]], key: str | None = CELL,
                    hot_rows: int | None = None, largest: int | None = None) -> DataFrame | None:
    if not wanted:
        return None
    qs = {c: sorted(wanted[c]) for c in sorted(wanted)}
    qt = quantiles(cycles, _keys(key), list(qs), qs, "nearest", hot_rows, largest)
    return qt.select(*_keys(key), *[F.col(f"{c}_{q_name(q)}").alias(_st(c, q_name(q))) for c in qs for q in qs[c]])


def _norm_exprs(c: str, methods: Sequence[str]) -> dict[str, Column]:
    """E4-E9; every method is gated on the cell's sample std > 0, as column discovery is in the reference."""
    x = F.col(c)
    g = lambda w: F.col(_st(c, w))
    std_ok = g("std") > 0
    out = {}
    for m in methods:
        if m == "first_cycle":
            e = F.when(std_ok & (g("first") > 0), safe_divide(x, g("first")))
        elif m == "max_value":
            e = F.when(std_ok & (g("max") > 0), safe_divide(x, g("max")))
        elif m == "percentile_95":
            e = F.when(std_ok & (g("p95") > 0), safe_divide(x, g("p95")))
        elif m == "percentile_99":
            e = F.when(std_ok & (g("p99") > 0), safe_divide(x, g("p99")))
        elif m == "z_score":
            e = F.when(std_ok, (x - g("mean")) / g("std"))
        elif m == "min_max":
            e = F.when(std_ok & (g("max") > g("min")), (x - g("min")) / (g("max") - g("min")))
        else:
            continue  # unknown method names are skipped (J2)
        out[f"{c}_norm_{m}"] = e
    return out


def _ordered_features(cycles: DataFrame, spec: FeatureSpec, caps: list[str], temps: list[str], hot: HotKeys) -> DataFrame:
    """E13, E16, E17, E18 rolling parts, via :func:`~cyclelake.operators.ordering.ordered_columns`: a plain
    per-cell window for cells up to ``spec.hot_rows`` rows, halo-chunked windows for larger cells."""
    lookback = 1
    if spec.rolling:
        lookback = max(lookback, max(spec.rolling_windows) - 1)
    if spec.temperature and temps:
        lookback = max(lookback, TEMPERATURE_WINDOW - 1)
    cyc = F.col(CYCLE)

    def build(w) -> dict[str, Column]:
        cols: dict[str, Column] = {}

        def rolling(x: Column, n: int) -> tuple[Column, Column]:
            frame = w.rowsBetween(-(n - 1), 0)
            full = F.count(x).over(frame) == n  # null until the frame holds n non-null values
            return F.when(full, F.avg(x).over(frame)), F.when(full, F.stddev_samp(x).over(frame))

        for c in caps:
            x = F.col(c)
            if spec.degrade:
                cols[f"{c}_fade_rate"] = ratio(x - F.lag(x).over(w), cyc - F.lag(cyc).over(w))
            if spec.rolling:
                for n in spec.rolling_windows:
                    mean, std = rolling(x, n)
                    cols[f"{c}_rolling_mean_{n}"] = mean
                    cols[f"{c}_rolling_std_{n}"] = std
        if spec.temperature:
            for t in temps:
                mean, std = rolling(F.col(t), TEMPERATURE_WINDOW)
                cols[f"{t}_rolling_{TEMPERATURE_WINDOW}"] = mean
                cols[f"{t}_std_{TEMPERATURE_WINDOW}"] = std
        return cols

    if not build(Window.partitionBy(CELL).orderBy(CYCLE)):
        return cycles
    return ordered_columns(cycles, [CELL], CYCLE, build, lookback, hot_rows=spec.hot_rows,
                           chunk_rows=spec.chunk_rows, known_hot=hot.largest > hot_group_rows(cycles, spec.hot_rows))


def _attached(rows: DataFrame, table: DataFrame, hot: HotKeys | None) -> DataFrame:
    """``rows`` with the statistics of their cell, or (``hot`` None) those of the whole table, one row, as a scalar subquery."""
    if hot is not None:
        return hot.join(rows, table)
    return rows.withColumn("_one", table.select(F.struct(*table.columns)).scalar()).select(*rows.columns, "_one.*")


def _end_of_life(cycles: DataFrame, stats: DataFrame, caps: Sequence[str], hot: HotKeys | None) -> DataFrame:
    """Per cell, or of the whole table: row count and, per column, the lowest cycle under 80 % of the cycle-1 value.

    Two partial aggregates: the cycle-1 value (in ``stats``) must be known before rows can be compared with it.
    """
    key = [hot.key] if hot is not None else []
    below = _attached(cycles, stats.select(*key, *[_st(c, "c1") for c in caps]), hot)
    return below.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_cell_rows"),
        *[F.min(F.when(F.col(c) < F.lit(EOL_FRACTION) * F.col(_st(c, "c1")), F.col(CYCLE)))
          .alias(_st(c, "eol")) for c in caps],
    )


def cycles_to_80pct(cycles: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """E15 as a per-cell table ``(cell_id, {x}_cycles_to_80pct)``: no windows, two partial aggregates."""
    caps = list(cols) if cols is not None else S.capacity_columns(cycles)
    stats = cell_stats(cycles, caps)
    eol = _end_of_life(cycles, stats, caps, hot_keys(cycles, CELL)).join(stats.select(CELL, *[_st(c, "c1") for c in caps]), CELL)
    return eol.select(CELL, *[
        F.when((F.col(_st(c, "c1")) > 0) & (F.col("_cell_rows") > 1), F.col(_st(c, "eol")))
        .alias(f"{c}_cycles_to_80pct") for c in caps])


def cycle_features(cycles: DataFrame, spec: FeatureSpec, by_cell: bool = True, hot: HotKeys | None = None) -> DataFrame:
    """Add the features chosen in ``spec`` to a cycle table keyed by (cell_id, regular_cycle_number).

    ``by_cell=False`` is the whole-table variant (E20): statistics over all rows, attached as scalar subqueries of one
    row. Order-dependent features (fade rate, rolling windows) stay per cell: a difference across two cells has no meaning.
    ``hot``: the hot cells, where known (else a job asks); they may be those of a table that holds more rows.
    """
    S.require_columns(cycles, [CELL, CYCLE])
    key = CELL if by_cell else None
    caps = S.capacity_columns(cycles)
    norms = S.normalisable_columns(cycles) if spec.normalise else []
    basics = S.basic_norm_columns(cycles) if spec.basic_norm else []
    temps = S.temperature_columns(cycles) if spec.temperature else []
    has_date = "test_date" in cycles.columns

    stat_cols = sorted(set(norms) | set(basics) | set(temps)
                       | (set(caps) if (spec.cycle or spec.degrade) else set()))
    want_q: dict[str, set[float]] = {}
    for c in norms:
        for m, q in (("percentile_95", 0.95), ("percentile_99", 0.99)):
            if m in spec.normalise:
                want_q.setdefault(c, set()).add(q)
    for c in basics:
        want_q.setdefault(c, set()).add(0.95)
    if spec.outliers:
        for c in caps:
            want_q.setdefault(c, set()).update({0.25, 0.75})

    hot = hot_keys(cycles, CELL, spec.hot_rows) if hot is None else hot
    base = cycles
    if spec.degrade or spec.rolling or (spec.temperature and temps):
        base = _ordered_features(cycles, spec, caps, temps, hot)

    need_date = spec.cycle and has_date and "cycle_age_days" not in cycles.columns
    # cycle age is always per cell; otherwise the first date comes with the statistics
    stats = cell_stats(cycles, stat_cols, first_date=need_date and by_cell, key=key)
    if need_date and not by_cell:
        base = hot.join(base, cycles.groupBy(CELL).agg(F.min("test_date").alias("_first_test_date")))
    own = hot if by_cell else None
    joined = _attached(base, stats, own)
    qt = _quantile_table(cycles, want_q, key, spec.hot_rows, hot.largest if by_cell else None)
    if qt is not None:
        joined = _attached(joined, qt, own)

    if spec.degrade and caps:
        # E15 needs the cycle-1 value before it can look for the first cycle under 80 % of it.
        joined = _attached(joined, _end_of_life(cycles, stats, caps, own), own)

    new: dict[str, Column] = {}
    if spec.cycle:
        if need_date:
            dtype = cycles.schema["test_date"].dataType
            micros = epoch_micros("test_date", dtype) - epoch_micros("_first_test_date", dtype)
            new["cycle_age_days"] = F.floor(micros / F.lit(86400 * 1_000_000)).cast("long")
        if "cumulative_cycles" not in cycles.columns:
            new["cumulative_cycles"] = F.col(CYCLE)
        for c in caps:
            if f"{c}_efficiency" not in cycles.columns:
                new[f"{c}_efficiency"] = ratio(F.col(c), F.col(_st(c, "max")))
    for c in norms:
        new.update(_norm_exprs(c, spec.normalise))
    for c in basics:
        c1, p95 = F.col(_st(c, "c1")), F.col(_st(c, "p95"))
        new[f"{c}_norm_reg"] = F.when(c1 > 0, F.col(c) / c1)
        new[f"{c}_norm_p95"] = F.when(p95 > 0, F.col(c) / p95)
    if spec.degrade:
        for c in caps:
            c1 = F.col(_st(c, "c1"))
            new[f"{c}_retention"] = F.when(c1 > 0, safe_divide(F.col(c), c1))
            new[f"{c}_cumulative_loss"] = F.when(c1 > 0, c1 - F.col(c))
            new[f"{c}_cycles_to_80pct"] = F.when((c1 > 0) & (F.col("_cell_rows") > 1), F.col(_st(c, "eol")))
    if spec.temperature:
        for t in temps:
            new[f"{t}_deviation"] = F.col(t) - F.col(_st(t, "mean"))
    if spec.outliers:
        k = F.lit(float(spec.outlier_factor))
        for c in caps:
            q1, q3 = F.col(_st(c, "p25")), F.col(_st(c, "p75"))
            iqr = q3 - q1
            new[f"{c}_outlier"] = (F.col(c) < q1 - k * iqr) | (F.col(c) > q3 + k * iqr)

    out = joined.withColumns(new) if new else joined
    if spec.min_cycles and by_cell:
        # B14 on the result: per-cell features depend only on the cell's own rows, so dropping short cells
        # afterwards equals dropping them first, and reuses the per-cell count instead of a semi join
        out = out.filter(F.col("_rows") >= spec.min_cycles)
    helpers = [c for c in out.columns if c.startswith("_")]
    return out.drop(*helpers)


def min_cycles_filter(cycles: DataFrame, min_cycles: int = MIN_CYCLES, keep_all_if_none: bool = False) -> DataFrame:
    """Keep cells with at least ``min_cycles`` rows (count by ``groupBy``, then a semi join).

    The reference returns the whole input when no cell qualifies (quirk Q4); that fallback needs an action,
    so it only runs when ``keep_all_if_none`` is set.
    """
    counts = cycles.groupBy(CELL).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_cycles)
    kept = matched(cycles, counts.select(CELL), CELL, "left_semi")
    if keep_all_if_none and kept.limit(1).count() == 0:
        return cycles
    return kept


def specific_metrics(df: DataFrame, mass_col: str = "total_active_mass_g",
                     capacity_cols: Sequence[str] | None = None,
                     energy_cols: Sequence[str] | None = None) -> DataFrame:
    """H3, H4: ``{x}_specific_mAh_g`` = 1000·x/mass and ``{x}_specific_Wh_g`` = x/mass when mass > 0."""
    if mass_col not in df.columns:
        return df
    caps, energies = S.specific_columns(df)
    caps = list(capacity_cols) if capacity_cols is not None else caps
    energies = list(energy_cols) if energy_cols is not None else energies
    m = F.col(mass_col)
    new = {f"{c}_specific_mAh_g": F.when(m > 0, F.lit(1000) * F.col(c) / m) for c in caps}
    new.update({f"{c}_specific_Wh_g": F.when(m > 0, F.col(c) / m) for c in energies})
    return df.withColumns(new) if new else df


def coulombic_efficiency(df: DataFrame) -> DataFrame:
    """H5: ``coulombic_efficiency_{charge}_{discharge}`` = discharge / charge by H1 (0.0 when charge is 0/NULL)."""
    new = {f"coulombic_efficiency_{c}_{d}": safe_divide(F.col(d), F.col(c))
           for c, d in S.charge_discharge_pairs(df)}
    return df.withColumns(new) if new else df
