"""Plan shape: no window partitioned by the cell key alone, broadcast of the cell table, pushed filters."""

import re

from cyclelake.operators.enrich import join_metadata
from cyclelake.plans import pipeline as PL
from cyclelake.sources import fixtures as fx

from conftest import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_path_has_no_cell_only_window(spark):
    # hot_rows=0 sends every cell through the split path: no window may be keyed by cell_id alone
    cfg = PL.ProcessingConfig()
    spec = cfg.spec().__class__(**{**cfg.spec().__dict__, "hot_rows": 0})
    from cyclelake.operators import features as FT
    out = FT.cycle_features(fx.cycles(spark, SMALL), spec)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", plan)
    assert specs, "expected windows"
    for spec_text in specs:
        if "regular_cycle_number" in spec_text:
            assert "_chunk" in spec_text or "_block" in spec_text, spec_text


def test_small_cells_use_one_window_without_checkpoint(spark):
    out = PL.process_cycle_data(fx.cycles(spark, SMALL), fx.cells(spark, SMALL))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(cell_id#" in plan.replace(" ", "") or "windowspecdefinition(cell_id" in plan


def test_metadata_join_is_broadcast(spark):
    out = join_metadata(fx.cycles(spark, SMALL), fx.cells(spark, SMALL))
    assert "BroadcastHashJoin" in _plan(out)


def test_filters_reach_the_scan(spark):
    cells = fx.cells(spark, SMALL).filter("nominal_capacity_ah > 45")
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "p_size" in plan


def test_partition_filter_prunes_export(spark):
    from __spark_entry__ import queries
    df = queries()["cycles_export_partitioned"](spark, SMALL).filter("test_year = 1995")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(test_year" in plan and "(test_year#" in plan


def test_search_comparisons_are_pushed_down(spark):
    from __spark_entry__ import queries
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        df = queries()["cells_search_ops"](spark, SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(test_year,2021)" in plan and "LessThan(nominal_capacity_ah,30.0)" in plan
