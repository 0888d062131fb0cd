"""Skew-safe positions, halo-chunked windows and quantiles against brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from cyclelake.operators import ordering as O


def _frame(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, regular_cycle_number long, x double")


def test_positions_with_a_hot_key(spark):
    # one cell holds most rows, spread over many range partitions
    rng = np.random.default_rng(1)
    rows = [(0, i, float(rng.normal())) for i in range(1, 3001)]
    rows += [(c, i, float(rng.normal())) for c in range(1, 40) for i in range(1, 11)]
    df = _frame(spark, rows)
    got = O.with_positions(df, ["cell_id"], ["x"]).toPandas()
    for cell, g in got.groupby("cell_id"):
        assert sorted(g["_pos"]) == list(range(1, len(g) + 1))
        assert (g.sort_values("_pos")["x"].diff().dropna() >= 0).all()
        assert (g["_group_rows"] == len(g)).all()


def test_block_positions_match_row_number(spark):
    rows = [(c, i * 3 + (c % 2), float(i)) for c in range(5) for i in range(1, 5000, 7)]
    df = _frame(spark, rows)
    got = O.with_block_positions(df, ["cell_id"], "regular_cycle_number", block_width=64)
    ref = df.withColumn("rn", F.row_number().over(
        Window.partitionBy("cell_id").orderBy("regular_cycle_number")))
    diff = got.join(ref, ["cell_id", "regular_cycle_number"]).filter(F.col("_pos") != F.col("rn")).count()
    assert diff == 0


def test_chunked_rolling_equals_plain_window(spark):
    rng = np.random.default_rng(2)
    rows = [(c, i, None if rng.random() < 0.1 else float(rng.normal())) for c in range(3) for i in range(1, 400)]
    df = _frame(spark, rows)
    pos = O.with_block_positions(df, ["cell_id"], "regular_cycle_number")
    chunked = O.with_chunks(pos, 4, chunk_rows=16)   # tiny chunks: many chunk borders
    w = O.chunk_window(["cell_id"]).rowsBetween(-4, 0)
    got = O.drop_halo(chunked.withColumn("m", F.avg("x").over(w)).withColumn("l", F.lag("x").over(
        O.chunk_window(["cell_id"]))))
    plain = Window.partitionBy("cell_id").orderBy("regular_cycle_number")
    ref = df.withColumn("m2", F.avg("x").over(plain.rowsBetween(-4, 0))).withColumn("l2", F.lag("x").over(plain))
    j = got.join(ref, ["cell_id", "regular_cycle_number"]).toPandas()
    assert len(j) == len(rows)
    assert np.allclose(j["m"].astype(float), j["m2"].astype(float), equal_nan=True)
    assert np.allclose(j["l"].astype(float), j["l2"].astype(float), equal_nan=True)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=1001)
    vals[::50] = np.nan
    df = spark.createDataFrame([(0, None if np.isnan(v) else float(v)) for v in vals], "cell_id long, x double")
    clean = np.sort(vals[~np.isnan(vals)])
    lin = O.quantiles(df, [], ["x"], [0.25, 0.5, 0.99], "linear").first()
    assert np.isclose(lin["x_p25"], np.percentile(clean, 25))
    assert np.isclose(lin["x_p50"], np.median(clean))
    assert np.isclose(lin["x_p99"], np.percentile(clean, 99))
    near = O.quantiles(df, ["cell_id"], ["x"], [0.95], "nearest").first()
    assert near["x_p95"] == clean[int(round((len(clean) - 1) * 0.95))]


def test_quantile_paths_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(c, float(rng.normal())) for c in range(4) for _ in range(int(rng.integers(1, 300)))]
    rows += [(9, None)]  # a group without values
    rows += [(None, float(v)) for v in range(50)]  # a NULL group
    rows += [(7, 1.0)] * 900 + [(7, float(v)) for v in range(100)]  # one value fills most of a group
    df = spark.createDataFrame(rows, "cell_id long, x double")
    for method in ("nearest", "linear"):
        a, b, c = ([tuple(r) for r in O.quantiles(df, ["cell_id"], ["x"], [0.25, 0.95], method, hot_rows=h)
                    .orderBy("cell_id").collect()] for h in (1000000, 0, 100))
        assert a == b == c, method


def _null_rows():
    rng = np.random.default_rng(5)
    rows = [(c, int(n), float(rng.normal())) for c in (None, 1, 2) for n in rng.integers(1, 40, 120)]  # repeats
    return rows + [(c, None, float(rng.normal())) for c in (None, 1, 3) for _ in range(20)]


def test_split_paths_keep_null_keys_null_orders_and_repeats(spark):
    df = _frame(spark, _null_rows())

    def build(w):
        return {"prev": F.lag("x").over(w), "mean": F.round(F.avg("x").over(w.rowsBetween(-3, 0)), 9)}

    results = []
    for hot in (10 ** 6, 130, 0):
        got = O.ordered_columns(df, ["cell_id"], "regular_cycle_number", build, 3, hot_rows=hot, chunk_rows=8)
        results.append(sorted(map(repr, got.select("cell_id", "regular_cycle_number", "x", "prev", "mean").collect())))
        shuffled = O.ordered_columns(df.repartition(5), ["cell_id"], "regular_cycle_number", build, 3, hot_rows=hot,
                                     chunk_rows=8)
        assert sorted(map(repr, shuffled.select("cell_id", "regular_cycle_number", "x", "prev", "mean").collect())) == results[-1]
    assert len(results[0]) == len(_null_rows()) and results[0] == results[1] == results[2]


def test_a_frequent_value_is_spread_over_windows(spark):
    df = _frame(spark, [(1, 5, float(i)) for i in range(2000)] + [(1, n, 0.0) for n in range(100)])
    pos = O.with_block_positions(df, ["cell_id"], "regular_cycle_number", block_width=64)
    assert sorted(r["_pos"] for r in pos.collect()) == list(range(1, 2101))
    got = pos.orderBy("_pos").collect()
    assert [r["regular_cycle_number"] for r in got] == sorted(r["regular_cycle_number"] for r in got)


def test_sizes_are_not_remembered(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("1 AS k", "id AS v").write.parquet(path)
    assert not O.group_sizes_have_hot(spark.read.parquet(path), ["k"], 500)
    spark.range(5000).selectExpr("1 AS k", "id AS v").write.mode("append").parquet(path)
    assert O.group_sizes_have_hot(spark.read.parquet(path), ["k"], 500)


def test_means_do_not_depend_on_partitioning(spark):
    from cyclelake.operators.summary import battery_metrics

    rng = np.random.default_rng(6)
    rows = [(int(c), i, round(float(rng.random()), 2)) for i, c in enumerate(rng.integers(0, 20, 2000))]
    df = spark.createDataFrame(rows, "cell_id long, regular_cycle_number long, discharge_capacity double")
    got = {n: battery_metrics(df.repartition(n)).select("cell_id", "capacity_mean").orderBy("cell_id").collect()
           for n in (1, 3, 7)}
    assert got[1] == got[3] == got[7]


def test_positions_agree_on_every_path(spark):
    df = _frame(spark, _null_rows() + [(5, i % 50, float(i)) for i in range(400)])
    seen = []
    for hot in (10 ** 6, 150, 0):
        got = O.with_positions(df.repartition(5), ["cell_id"], ["regular_cycle_number"], hot_rows=hot)
        assert got.columns == [*df.columns, "_group_rows", "_pos"] and got.schema["_pos"].dataType.typeName() == "long"
        seen.append(sorted(map(repr, got.collect())))
    assert len(seen[0]) == df.count() and seen[0] == seen[1] == seen[2]


def test_positions_of_small_groups_take_one_exchange(spark):
    df = _frame(spark, [(c, i, float(i)) for c in range(50) for i in range(20)])
    plan = O.with_positions(df, ["cell_id"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(cell_id" in plan and "Scan ExistingRDD[cell_id" in plan
    exchanged = next(line for line in plan.splitlines() if "Exchange" in line)
    assert "_tie" not in exchanged and "Join" not in plan
