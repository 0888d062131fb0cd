"""Joins of a hot key's rows with per-key statistics, narrowed brackets, and the whole-table pipeline's plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclelake.operators import features as FT
from cyclelake.operators import ordering as O
from cyclelake.operators import skew
from cyclelake.operators.enrich import semi_join_ids
from cyclelake.plans import pipeline as PL
from cyclelake.sources import fixtures as fx

from conftest import SMALL


@pytest.fixture
def no_broadcasts(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _hot(spark, n=60000):
    """Half of the rows in one cell, a tenth without a cell."""
    cell = F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 997 + 1)
    return spark.range(n).select(cell.cast("long").alias("cell_id"), F.col("id").alias("regular_cycle_number"),
                                 (F.col("id") % 101).cast("double").alias("discharge_capacity"))


def test_a_hot_cell_is_dealt_to_bounded_parts(spark, no_broadcasts):
    df, limit = _hot(spark), 2000
    hot = skew.hot_keys(df, "cell_id", limit)
    assert hot.largest == 30000 and hot.limit == limit
    table = df.groupBy("cell_id").agg(F.max("discharge_capacity").alias("most"))
    out = hot.join(df, table)
    # the most rows of a task; the statistic is read, or the join would be dropped
    held = lambda d: d.groupBy(F.spark_partition_id()).agg(F.count("most").alias("n")).agg(F.max("n")).first()[0]
    assert held(out) <= 2 * (60000 // 32 + limit)  # an even share and at most a few parts
    plain = df.join(table, "cell_id", "left")
    assert held(plain) >= 30000
    assert out.columns == plain.columns and out.exceptAll(plain).count() == 0 and plain.exceptAll(out).count() == 0


def test_the_list_of_hot_keys_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 5)
    df = spark.range(1000).select((F.col("id") % 100).alias("cell_id"))
    hot = skew.hot_keys(df, "cell_id", 1)
    assert hot.limit == 200 and hot.parts is None
    assert skew.hot_keys(df.limit(0), "cell_id", 1).parts is None


def test_features_agree_with_and_without_hot_cells(spark):
    df = _hot(spark, 4000).where("cell_id IS NOT NULL")
    spec = FT.FeatureSpec(cycle=True, normalise=("max_value", "percentile_95"), degrade=True, outliers=True)
    rows = []
    for limit in (10 ** 6, 300):
        got = FT.cycle_features(df, FT.FeatureSpec(**{**spec.__dict__, "hot_rows": limit, "chunk_rows": 64}))
        rows.append(sorted(map(repr, got.select(*sorted(got.columns)).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == df.count()


def test_semi_joins_exchange_their_keys(spark, no_broadcasts):
    df = _hot(spark, 3000)
    for out in (semi_join_ids(df, df.select("cell_id").where("cell_id < 50")), FT.min_cycles_filter(df, 3)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in plan and "coalesce(cell_id" in plan.replace("_match_", "")
    some = df.select("cell_id").where("cell_id < 5 OR cell_id IS NULL")
    assert semi_join_ids(df, some).exceptAll(df.where("cell_id < 5")).count() == 0
    assert semi_join_ids(df, some).count() == df.where("cell_id < 5").count() > 1500


@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_brackets_are_narrowed_until_they_are_small(spark, monkeypatch, method):
    monkeypatch.setattr(O, "SKETCH_ACCURACY", 40)
    monkeypatch.setattr(O, "BRACKET_VALUES", 20)
    monkeypatch.setattr(O, "NARROW", 4)
    rng = np.random.default_rng(3)
    rows = [(c, float(v)) for c in (1, None) for v in rng.permutation(4000) / 7] + [(2, 1.5)] * 900 + [(2, float(v)) for v in range(300)]
    rows += [(3, None), (4, 0.0), (4, -0.0)]
    df = spark.createDataFrame(rows, "cell_id long, x double").repartition(7)
    qs = [0.0, 0.03, 0.5, 0.95, 1.0]
    got = O.quantiles(df, ["cell_id"], ["x"], qs, method, hot_rows=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile_approx") > 10  # several rounds
    order = lambda d: sorted(map(repr, d.collect()))
    assert order(got) == order(O.quantiles(df, ["cell_id"], ["x"], qs, method, hot_rows=10 ** 6))
    whole = [O.quantiles(df, [], ["x"], qs, method, hot_rows=h).collect() for h in (0, 10 ** 6)]
    assert whole[0] == whole[1]


def test_narrowing_bounds_the_last_window(spark, monkeypatch):
    monkeypatch.setattr(O, "SKETCH_ACCURACY", 100)
    values = [(1, float(v)) for v in range(50000)]
    counts = spark.createDataFrame(values, "cell_id long, _x double").withColumns(
        {"_col": F.lit(0), "_q": F.lit(0), "_n": F.lit(1).cast("long"), "_all": F.lit(50000).cast("long"),
         "_piece": F.lit(0).cast("long"), "_base": F.lit(0).cast("long")})
    at = F.lit(25001)
    left = O._narrowed(counts, ["cell_id"], at, at)
    rows = left.collect()
    assert len(rows) < 50000 / 30 and any(r["_x"] == 25000.0 for r in rows)
    again = O._narrowed(left, ["cell_id"], at, at).collect()
    assert len(again) < 100 and min(r["_x"] for r in again) == again[0]["_base"]


def test_quantiles_ask_each_column_for_its_own(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0), (1, 2.0, 5.0)], "k long, a double, b double")
    for limit in (0, 100):
        got = O.quantiles(df, ["k"], ["a", "b"], {"a": [0.5], "b": [0.25, 1.0]}, "linear", hot_rows=limit)
        assert got.columns == ["k", "a_p50", "b_p25", "b_p100"] and tuple(got.first()) == (1, 1.5, 4.25, 5.0)


def test_whole_table_pipeline_has_no_nested_loops(spark, no_broadcasts):
    out = PL.process_cycle_data(fx.cycles(spark, SMALL), None, group_by_cell=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
