"""What the derived tables and the feature pipeline exchange: no wide row twice, no checkpoint of bounded groups."""

import os
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclelake.operators import sequence as SEQ
from cyclelake.operators.enrich import join_metadata, semi_join_ids
from cyclelake.operators.skew import hot_keys
from cyclelake.plans import pipeline as PL
from cyclelake.plans import queries_surface
from cyclelake.session import checkpoint_dir
from cyclelake.sources import fixtures as fx

from conftest import SMALL


def _checkpointed(spark) -> set[str]:
    return {os.path.join(d, f) for d, _, files in os.walk(checkpoint_dir(spark)) for f in files if "/rdd-" in d}


def test_the_search_reads_cycles_that_were_not_checkpointed(spark, monkeypatch):
    monkeypatch.setattr(fx, "input_key", lambda spark, sf: f"{sf}:built anew")
    before = _checkpointed(spark)
    assert queries_surface.cells_search_substring(spark, SMALL).count() > 0
    assert _checkpointed(spark) == before


def test_the_search_neither_exchanges_nor_writes_cycles(spark, monkeypatch):
    built = []
    monkeypatch.setattr(fx, "materialise", lambda spark, name, key, build: built.append((name, build())) or built[-1][1])
    queries_surface.cells_search_substring(spark, SMALL)
    assert [name for name, _ in built] == ["cells_rollup"]
    plan = built[0][1]._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan and "REPARTITION_BY_COL" not in plan


@pytest.mark.parametrize("hot_rows", ["0", "30", str(1 << 20)])
def test_the_roll_up_is_that_of_the_numbered_cycles(spark, monkeypatch, tmp_path, hot_rows):
    """With cycles that tie in the order, with NULL order values, and without a capacity; and cells without one, or without a cycle."""
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    tied = rows.where("l_partkey < 60").withColumns({"l_quantity": F.expr("IF(l_orderkey % 3 = 0, NULL, l_quantity + 7)"), "l_tax": F.lit(0.5)})
    undated = rows.where("l_partkey % 4 = 0").withColumns({"l_shipdate": F.expr("CAST(NULL AS timestamp)"), "l_quantity": F.lit(-3.0)})
    empty = rows.where("l_partkey = 61").withColumns({"l_partkey": F.lit(62).cast("long"), "l_quantity": F.expr("CAST(NULL AS double)")})
    nowhere = rows.where("l_partkey = 63").withColumn("l_partkey", F.expr("CAST(NULL AS bigint)"))
    reduce(DataFrame.unionByName, [rows.where("l_partkey NOT IN (62, 65)"), tied, undated, empty, nowhere]).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{SMALL}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(fx, "materialise", lambda spark, name, key, build: build())
    spark.conf.set("spark.cyclelake.hotGroupRows", hot_rows)
    try:
        cyc, number = fx.cycles(spark, str(tmp_path)), F.col("regular_cycle_number")
        has_cap = F.when(F.col("discharge_capacity").isNotNull(), number)
        want = cyc.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.max(number).alias("m"), F.max_by("discharge_capacity", has_cap).alias("l"),
                                          F.min_by("discharge_capacity", has_cap).alias("f")).collect()
        ways = [fx.cells_rollup(spark, str(tmp_path)).collect(), fx.cells_rollup(spark, str(tmp_path), cyc).collect()]
    finally:
        spark.conf.unset("spark.cyclelake.hotGroupRows")
    want = {r.cell_id: (r.n, r.m, r.l, r.l / r.f if r.f and r.f > 0 else None) for r in want}
    for way in ways:
        got = {r.cell_id: (r.regular_cycles, r.total_cycles, r.last_discharge_capacity, r.discharge_capacity_retention) for r in way}
        assert len(way) == len(got) == 200 and got[62][2:] == (None, None) and got[65] == (None,) * 4
        assert {k: v for k, v in got.items() if v[0]} == {k: v for k, v in want.items() if k is not None}


@pytest.fixture
def no_broadcasts(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _exchanged(df) -> list[str]:
    """Every exchange of the plan with its columns."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange hashpartitioning" in line]


def test_features_are_not_exchanged_again_for_metadata(spark, no_broadcasts):
    plan = _exchanged(PL.process_cycle_data(fx.cycles(spark, SMALL), fx.cells(spark, SMALL)))
    assert plan and not any("coalesce(" in line for line in plan)
    rows = PL.process_cycle_data(fx.cycles(spark, SMALL), None)
    assert len(plan) == len(_exchanged(rows)) + 1  # the cells


def test_features_keep_rows_without_cells_and_hot_cells(spark):
    cycles = fx.cycles(spark, SMALL).where("cell_id < 30")
    cells = fx.cells(spark, SMALL).where("cell_id < 20")
    hot = hot_keys(cycles, "cell_id", 10)
    assert hot.parts is not None
    ways = [join_metadata(cycles, cells), join_metadata(cycles, cells, hot=hot), join_metadata(cycles, cells, hot=hot_keys(cycles, "cell_id"))]
    assert ways[0].columns == ways[1].columns == ways[2].columns
    rows = [sorted(map(repr, way.collect())) for way in ways]
    assert len(rows[0]) == cycles.count() and rows[0] == rows[1] == rows[2]


def test_a_full_run_deals_its_cycles_by_cell_once(spark, no_broadcasts, monkeypatch):
    built, write = [], PL.Q.validate_while_writing
    monkeypatch.setattr(PL.Q, "validate_while_writing", lambda df, *more: built.append(df) or write(df, *more))
    config = PL.create_processing_config(["max_value"], min_cycles=30, add_degradation=False, add_rolling=False)
    out = PL.load_and_process(fx.cells_rollup(spark, SMALL), fx.cycles(spark, SMALL), filters={"test_status": "active"}, config=config)
    plan = _exchanged(built[0])
    assert out["cycles"].count() > 0 and plan and not any("coalesce(" in line for line in plan)


def test_chosen_ids_keep_the_same_rows_with_hot_cells(spark):
    cycles = fx.cycles(spark, SMALL).where("cell_id < 30").unionByName(fx.cycles(spark, SMALL).where("cell_id = 1").withColumn(
        "cell_id", F.lit(None).cast("long")))
    ids = spark.sql("SELECT * FROM VALUES (1L), (1L), (7L), (NULL), (9999999L) AS t(cell_id)")
    ways = [semi_join_ids(cycles, ids)] + [semi_join_ids(cycles, ids, hot=hot_keys(cycles, "cell_id", n)) for n in (10, 10 ** 6)]
    rows = [sorted(map(repr, way.select(*cycles.columns).collect())) for way in ways]
    assert len(rows[0]) == cycles.where("cell_id IN (1, 7)").count() > 0 and rows[0] == rows[1] == rows[2]


def test_days_come_from_one_exchange_of_the_rows(spark, no_broadcasts, monkeypatch):
    built = []
    monkeypatch.setattr(fx, "materialise", lambda spark, name, key, build: built.append((name, build())) or built[-1][1])
    days = fx.cycles_by_day(spark, SMALL)
    assert [name for name, _ in built] == ["cycles_by_day"]  # not the cycles, to be read back
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_COL" in plan  # the rows; first dates
    monkeypatch.undo()
    cyc = fx.cycles(spark, SMALL)
    first = cyc.groupBy("cell_id").agg(F.min("test_date").alias("t0"))
    old = cyc.join(first, "cell_id").select("cell_id", F.col("regular_cycle_number").alias("cycle_index"), "test_date",
                                            (F.datediff(F.to_date("test_date"), F.to_date("t0")) + 1).cast("long").alias("regular_cycle_number"))
    both = ["cell_id", "cycle_index", "test_date", "regular_cycle_number"]
    assert days.count() == old.count() and days.select(both).exceptAll(old.select(both)).count() == 0


def test_steps_of_numbers_carry_no_row_hash(spark, no_broadcasts):
    steps = SEQ.cycle_steps(fx.cycles_by_day(spark, SMALL), hot_rows=10 ** 6)
    assert "_tie" not in steps._jdf.queryExecution().executedPlan().toString()
    split = SEQ.cycle_steps(fx.cycles_by_day(spark, SMALL), hot_rows=0)
    assert sorted(map(repr, steps.collect())) == sorted(map(repr, split.collect()))
