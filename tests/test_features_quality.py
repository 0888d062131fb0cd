"""Feature and rule semantics on hand-built rows (edge cases and the quirk decisions of the survey)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclelake.operators import features as FT
from cyclelake.operators import ordering
from cyclelake.operators import quality as Q
from cyclelake.operators import schema as S
from cyclelake.plans import pipeline as PL

SCHEMA = ("cell_id long, regular_cycle_number long, discharge_capacity double, charge_capacity double, "
          "voltage double")


def test_no_cycle_one_gives_null_retention(spark):
    rows = [(1, c, 10.0 - c * 0.1, 11.0, 3.7) for c in range(2, 30)]       # no cycle 1 (Q6)
    rows += [(2, c, 0.0 if c == 1 else 5.0, 5.0, 3.7) for c in range(1, 30)]  # cycle-1 value not > 0
    df = spark.createDataFrame(rows, SCHEMA)
    out = FT.cycle_features(df, FT.FeatureSpec(degrade=True)).collect()
    assert all(r.discharge_capacity_retention is None for r in out)
    assert all(r.discharge_capacity_cumulative_loss is None for r in out)
    assert "discharge_capacity_cycles_to_80pct" in out[0].asDict()


def test_cycles_to_80pct_and_fade(spark):
    rows = [(1, c, 10.0 - c * 0.5, 11.0, 3.7) for c in range(1, 11)]
    out = {r.regular_cycle_number: r for r in
           FT.cycle_features(spark.createDataFrame(rows, SCHEMA), FT.FeatureSpec(degrade=True)).collect()}
    # cycle-1 value 9.5; first value under 7.6 is 7.5 at cycle 5
    assert out[3].discharge_capacity_cycles_to_80pct == 5
    assert out[1].discharge_capacity_fade_rate is None
    assert out[2].discharge_capacity_fade_rate == pytest.approx(-0.5)


def test_constant_column_is_not_normalised(spark):
    rows = [(1, c, float(c), 1.0, 3.7) for c in range(1, 25)]
    out = FT.cycle_features(spark.createDataFrame(rows, SCHEMA),
                            FT.FeatureSpec(normalise=("first_cycle", "z_score"))).collect()
    assert all(r.voltage_norm_first_cycle is None for r in out)         # std 0 → NULL
    assert all(r.charge_capacity_norm_z_score is None for r in out)
    assert out[0].discharge_capacity_norm_first_cycle is not None


def test_rolling_needs_full_window(spark):
    rows = [(1, c, float(c), None if c == 7 else float(c), 3.7) for c in range(1, 15)]
    out = {r.regular_cycle_number: r for r in FT.cycle_features(
        spark.createDataFrame(rows, SCHEMA), FT.FeatureSpec(rolling=True, rolling_windows=(5,))).collect()}
    assert out[4].discharge_capacity_rolling_mean_5 is None
    assert out[5].discharge_capacity_rolling_mean_5 == pytest.approx(3.0)
    assert out[9].charge_capacity_rolling_mean_5 is None           # a NULL inside the frame (Q7 semantics)
    assert out[12].charge_capacity_rolling_mean_5 == pytest.approx(10.0)


def test_discharge_is_not_a_charge_column(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 0.0, 3.7)], SCHEMA)
    assert S.charge_discharge_pairs(df) == [("charge_capacity", "discharge_capacity")]  # Q10
    r = FT.coulombic_efficiency(df).first()
    assert r.coulombic_efficiency_charge_capacity_discharge_capacity == 0.0  # H1 default


def test_null_cell_ids_dropped_and_min_cycles(spark):
    rows = [(None, 1, 1.0, 1.0, 3.7)] + [(1, c, 1.0 + c, 1.0, 3.7) for c in range(1, 25)] + \
           [(2, c, 1.0, 1.0, 3.7) for c in range(1, 5)]
    out = PL.process_cycle_data(spark.createDataFrame(rows, SCHEMA))
    assert {r.cell_id for r in out.select("cell_id").distinct().collect()} == {1}
    none = PL.process_cycle_data(spark.createDataFrame(rows[25:], SCHEMA),
                                 config=PL.ProcessingConfig(keep_all_if_no_cell_qualifies=True))
    assert none.count() == 4  # Q4 fallback only on request


def test_infinities_cleaned_nan_kept(spark):
    df = spark.createDataFrame([(1, c, float("inf") if c == 2 else float(c), float("nan"), 3.7)
                                for c in range(1, 22)], SCHEMA)
    out = PL.process_cycle_data(df, config=PL.ProcessingConfig(add_rolling_features=False))
    r = out.filter("regular_cycle_number = 2").first()
    assert r.discharge_capacity is None and math.isnan(r.charge_capacity)


def test_empty_frame_rules_and_report(spark):
    df = spark.createDataFrame([], SCHEMA)
    res = Q.validate_battery_data(df)
    assert res.count() == 0
    rep = Q.report(res).first()
    assert rep.quality_score == 1.0 and rep.is_valid


def test_rules_and_strict_report(spark):
    rows = [(0, 1, -1.0, 2000.0, 6.0), (1, 2, 1.0, 1.0, 3.0), (1, 3, 1.0, None, 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    res = {r.rule_name: r for r in Q.validate_battery_data(df).collect()}
    assert not res["range:cell_id"].passed and res["range:cell_id"].error_count == 1
    assert res["range:cell_id"].failed_rows == 1  # Q12: bounds and rows both reported
    assert not res["capacity_columns"].passed and res["capacity_columns"].error_count == 2
    assert not res["voltage_columns"].passed
    assert res["required:cell_id"].passed
    rep = Q.report(Q.validate_battery_data(df, strict_mode=True)).first()
    assert rep.errors == rep.failed_validations and not rep.is_valid
    assert 0.0 <= rep.quality_score <= 1.0


def test_custom_rules(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.7), (1, 2, 3.0, 2.0, 3.7)], SCHEMA)

    def boom(_):
        raise RuntimeError("no")

    rules = [Q.custom("x", lambda d: F.col("charge_capacity") >= F.col("discharge_capacity"), name="row"),
             Q.custom("x", lambda d: F.count(F.lit(1)) == 2, name="agg"),
             Q.custom("x", boom, name="raises")]
    res = {r.rule_name: r for r in Q.validate(df, rules).collect()}
    assert not res["row"].passed and res["row"].failed_rows == 1
    assert res["agg"].passed
    assert not res["raises"].passed and "raised" in res["raises"].details


def test_quick_check_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, None, 1.0, 3.7)] * 3, SCHEMA)
    r = Q.quick_check(df).first()
    assert r.duplicate_rows == 2 and r.all_null_columns == ["discharge_capacity"] and r.status == "issues_found"


def test_hot_path_equals_plain_path(spark):
    """Forcing every cell through the split (hot) path with tiny chunks gives the same features."""
    import numpy as np
    rng = np.random.default_rng(5)
    rows = [(c, i, float(rng.normal(10, 1)), None if rng.random() < 0.1 else float(rng.normal(11, 1)), 3.7)
            for c in range(3) for i in range(1, 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    base = FT.FeatureSpec(degrade=True, rolling=True, outliers=True, normalise=("first_cycle", "percentile_95"))
    hot = FT.FeatureSpec(degrade=True, rolling=True, outliers=True, normalise=("first_cycle", "percentile_95"),
                         hot_rows=0, chunk_rows=32)
    a = FT.cycle_features(df, base).toPandas().sort_values(["cell_id", "regular_cycle_number"]).reset_index(drop=True)
    b = FT.cycle_features(df, hot).toPandas().sort_values(["cell_id", "regular_cycle_number"]).reset_index(drop=True)
    assert list(a.columns) == list(b.columns) and len(a) == len(b) == len(rows)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c], equal_nan=True), c
        else:
            assert a[c].equals(b[c]), c


def test_type_check_and_required(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([(1, 1, 1.0, 1.0, 3.7)], SCHEMA)
    res = {r.rule_name: r for r in Q.validate(df, [
        Q.type_check("voltage", T.DoubleType()), Q.type_check("cell_id", [T.IntegerType(), T.StringType()]),
        Q.type_check("nope", T.DoubleType()), Q.required("nope")]).collect()}
    assert res["type:voltage"].passed and not res["type:cell_id"].passed
    assert not res["type:nope"].passed and not res["required:nope"].passed


def test_axis_columns(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1.0, 3.7)], SCHEMA).withColumn("cell_name", F.lit("a"))
    cols = S.axis_columns(df, preferred=["voltage"])
    assert cols["numeric"][0] == "voltage" and "cell_name" not in cols["numeric"]
    assert "cell_name" in cols["grouping"] and "cell_id" in cols["grouping"]


def test_load_and_process_runs_lazily(spark):
    from conftest import SMALL
    from cyclelake.sources import fixtures as fx
    out = PL.load_and_process(fx.cells_rollup(spark, SMALL), fx.cycles(spark, SMALL),
                              cell_ids=fx.cells(spark, SMALL).filter("test_year = 2020").select("cell_id"))
    rep = out["report"].first()
    assert rep.total_rules == 9 and 0.0 <= rep.quality_score <= 1.0
    years = {r.test_year for r in out["cycles"].select("test_year").distinct().collect()}
    assert years == {2020}
    out["cycles"].unpersist()


def test_rule_details_text(spark):
    rows = [(0, 1, -1.0, 2000.0, 6.0), (1, 2, 1.0, 1.0, 3.0), (1, 3, 1.0, None, 0.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    res = {r.rule_name: r.details for r in Q.validate_battery_data(df).collect()}
    assert res["range:cell_id"] == "1 rows < 1"
    assert res["capacity_columns"] == ("discharge_capacity: 1 rows < 0; "
                                       "charge_capacity: 1 rows > 1000")
    assert res["voltage_columns"] == "voltage: 1 rows < 1.0 V; voltage: 1 rows > 5.0 V"
    assert res["cycle_numbers:regular_cycle_number"] == "0 odd cycle numbers"
    assert res["cycle_numbers:cycle_number"] == "no column cycle_number"
    pat = {r.rule_name: r.details for r in Q.validate(df.withColumn("s", F.lit("ab")),
                                                       [Q.pattern_check("s", "^a")]).collect()}
    assert pat["pattern:s"] == "3 of 3 rows match"


def test_numeric_validation_reports_every_column(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, inf, None, "x"), (-2.0, 1.0, None, "y"), (6.0, 2.0, None, "z")],
                               "voltage double, efficiency double, energy double, name string")
    got = {r.column_name: r for r in Q.numeric_validation(df, ["voltage", "efficiency", "energy", "name", "gone"], min_value=0,
                                                          check_outliers=True).collect()}
    assert got["voltage"].errors == ["below minimum"] and not got["voltage"].valid
    assert got["voltage"].warnings == ["negative voltage", "voltage over 5"]
    assert got["efficiency"].errors == ["infinite values"] and got["efficiency"].max == 2.0
    assert got["energy"].warnings == ["null values", "no values"] and got["energy"].valid
    assert got["name"].errors == ["not numeric"] and got["name"].data_type == "string"
    assert got["gone"].errors == ["missing"] and got["gone"].data_type is None and not got["gone"].valid


def test_low_charge_ratio_is_reported(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, 0.8)], "discharge_capacity double, charge_capacity double")
    rows = Q.cycle_data_validation(df).collect()
    assert len(rows) == 2 and all(r.low_ratio and r.all_valid and abs(r.charge_discharge_ratio - 0.65) < 1e-12 for r in rows)


@pytest.mark.parametrize("hot", ["16384", "0"])  # gathered and bracketed quantiles
def test_outlier_counts_of_several_columns_by_every_method(spark, monkeypatch, hot):
    monkeypatch.setattr(ordering, "GATHER_ROWS", int(hot))
    rows = [(float(i % 10), float(i * i % 7), None) for i in range(200)] + [(500.0, float("inf"), None), (-500.0, 90.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for method in ("iqr", "zscore", "modified_zscore"):
        got = {r[0]: r[1] for r in Q._outlier_counts(df, ["a", "b", "c"], method).collect()}
        for c, values in (("a", [r[0] for r in rows]), ("b", [r[1] for r in rows if r[1] != float("inf")])):
            x = np.array(values)
            if method == "iqr":
                q1, q3 = np.percentile(x, [25, 75])
                far = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
            elif method == "zscore":
                far = np.abs(x - x.mean()) / x.std() > 3
            else:
                off = x - np.median(x)
                far = np.abs(0.6745 * off / np.median(np.abs(off))) > 3.5
            assert got[c] == far.sum() > 0
        assert got["c"] == 0
