"""Clustered tables, bounded exports, pages by key, and rules measured by a write."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclelake.operators import paging as PG
from cyclelake.operators import profiles as PR
from cyclelake.operators import quality as Q
from cyclelake.operators import summary as SM
from cyclelake.session import checkpoint_dir
from cyclelake.sources import fixtures as fx
from cyclelake.sources import layout as LY
from cyclelake.sources import tables as TB

from conftest import SMALL


def _path(spark):
    return os.path.join(checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _read_files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def _cycles(spark, n=20000):
    """A third of the rows in cell 7, some without a cell."""
    cell = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 499)
    return spark.range(n).select(cell.cast("long").alias("cell_id"), F.col("id").alias("regular_cycle_number"),
                                 (F.col("id") % 5).alias("year"))


def test_clustered_lookups_read_few_files(spark):
    df, path = _cycles(spark), _path(spark)
    LY.write_clustered(df, path, "cell_id", ["regular_cycle_number"], bands=64, rows_per_file=1000, tasks=8)
    table = LY.ClusteredTable.read(spark, path, "cell_id")
    assert _rows(table.rows()) == _rows(df)
    files = glob.glob(f"{path}/*/*.parquet")
    assert len(files) <= 8 + 65 - 1 + 20
    few = [11, 12, None, 10_000]
    ids = spark.createDataFrame([(i,) for i in few * 3], "x long")  # repeats match once
    want = _rows(df.where(F.col("cell_id").isin(11, 12)))
    for chosen in (few, ids):
        got = table.rows_of(chosen)
        assert _rows(got) == want and got.columns == df.columns
    assert "_band_of_64" in table.rows_of(few)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert len(_read_files(table.rows_of(ids))) <= len(files) / 4
    assert table.rows_of([]).count() == table.rows_of(ids.limit(0)).count() == 0
    assert _rows(TB.cycles_for_cells(table, ids)) == want


def test_a_hot_cell_is_written_by_many_tasks(spark):
    path = _path(spark)
    LY.write_clustered(_cycles(spark), path, "cell_id", bands=16, rows_per_file=10**6, tasks=8)
    sizes = [r["n"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 2 * 20000 / 8  # cell 7 alone holds 6,667 rows


def test_appended_rows_are_found_and_mixed_bands_refused(spark):
    path = _path(spark)
    LY.write_clustered(_cycles(spark, 500), path, "cell_id", bands=8)
    LY.write_clustered(spark.createDataFrame([(11, 99999, 1)], "cell_id long, regular_cycle_number long, year long"), path,
                       "cell_id", bands=8, mode="append")
    assert 99999 in [r[1] for r in LY.ClusteredTable.read(spark, path, "cell_id").rows_of([11]).collect()]
    with pytest.raises(ValueError):
        LY.ClusteredTable(spark.read.parquet(path).drop("_band_of_8"), "cell_id").rows_of([11])


def test_sorted_export_bounds_its_files(spark):
    df, path = _cycles(spark), _path(spark)
    LY.write_sorted(df.repartition(16), path, ["year"], ["cell_id"], rows_per_file=3000, tasks=6)
    files = glob.glob(f"{path}/*/*.parquet")
    assert len(files) <= 6 + 5 - 1 + 20000 // 3000
    assert all(spark.read.parquet(f).count() <= 3000 for f in files)
    cells = [r[0] for r in spark.read.parquet(files[0]).collect()]
    assert cells == sorted(cells, key=lambda c: (c is not None, c or 0))
    assert _rows(TB.read_table(spark, path).select("cell_id", "regular_cycle_number", "year")) == _rows(df)


def test_pages_by_key_hold_every_row_once(spark):
    rows = [(i % 7 if i % 5 else None, i // 40) for i in range(230)]  # ties, copies and nulls
    df = spark.createDataFrame(rows, "a long, b long")
    path = _path(spark)
    PG.page_directory(df, ["a"], 30).write.parquet(path)
    pages = PG.Pages(df, spark.read.parquet(path), ("a",), 30)
    got = [list(map(tuple, pages.page(n).collect())) for n in range(9)]
    assert [len(g) for g in got] == [30] * 7 + [20, 0]
    flat = [r for g in got for r in g]
    assert sorted(flat, key=str) == sorted(rows, key=str)
    firsts = [r[0] for r in flat]
    assert firsts == sorted(firsts, key=lambda a: (a is not None, a or 0))
    assert PG.page_directory(df.limit(0), ["a"], 30).count() == 0


def test_a_deep_page_is_a_filter_of_the_scan(spark):
    path = _path(spark)
    spark.range(5000).repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(path)
    df = spark.read.parquet(path)
    directory = _path(spark)
    PG.page_directory(df, ["id"], 100).write.parquet(directory)
    page = PG.Pages(df, spark.read.parquet(directory), ("id",), 100).page(40)
    assert [r[0] for r in page.collect()] == list(range(4000, 4100))
    assert "GreaterThanOrEqual(id,4000)" in page._jdf.queryExecution().executedPlan().toString()


def test_rules_measured_by_a_write_equal_rules_read_back(spark):
    df = fx.cycles(spark, SMALL)
    rules = [*Q.cycle_data_rules(df), *Q.cell_metadata_rules(df), Q.pattern_check("cell_id", "^[0-9]+$"),
             Q.type_check("voltage", T.DoubleType()), Q.range_check("gone", 0, 1),
             Q.custom("temperature", lambda d: F.max("temperature") < 120, name="warm"),
             Q.custom("cell_id", lambda d: F.count_distinct("cell_id") > 3, name="some_cells"),
             Q.custom("voltage", lambda d: F.col("voltage") > 1, name="row_wise")]
    path = _path(spark)
    measured = _rows(Q.validate_while_writing(df, rules, path))
    assert measured == _rows(Q.validate(df, rules)) and len(measured) == len(rules)
    assert _rows(spark.read.parquet(path)) == _rows(df)
    assert Q.validate_while_writing(df.where("cell_id < 0"), Q.battery_standards(), _path(spark)).collect() == []
    assert Q.validate_while_writing(df.limit(0), Q.battery_standards(), _path(spark)).collect() == []


def test_profiles_follow_added_and_removed_files(spark):
    path, states = _path(spark), _path(spark)
    rows = [(i, float("inf") if i % 50 == 0 else None if i % 7 == 0 else 1e9 + i % 13 / 8) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b double")
    df.where("a < 200").repartition(3).write.parquet(path)
    assert PR.update_states(spark.read.parquet(path), states) == 3
    df.where("a >= 200").coalesce(1).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    assert PR.update_states(table, states) == 1 and PR.update_states(table, states) == 0
    got = {r["column_name"]: r for r in PR.merged_profile(spark, states, table.inputFiles()).collect()}
    for r in SM.column_profile(table, ["a", "b"]).collect():
        mine = got[r["column_name"]]
        assert all(mine[c] == r[c] for c in ("total_count", "null_count", "inf_count", "min", "max"))
        assert abs(mine["mean"] - r["mean"]) < 1e-6 and abs(mine["std"] - r["std"]) < 1e-6
    kept = table.inputFiles()[:2]
    part = PR.merged_profile(spark, states, kept).where("column_name = 'a'").first()
    assert part["total_count"] == spark.read.parquet(*kept).count()


def test_documents_without_a_row_schema(spark):
    folder = _path(spark)
    lines = ['{"query_result": {"data": {"rows": [{"a": 1, "b": "x"}, {"a": 2.5, "c d": [1]}]}}}',
             '{"query_result": {"data": {"rows": [{"a": "three"}, {}]}}}', "", '{"query_result": {"data": {"rows": null}}}',
             '{"query_result": {"data": {}}}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(folder)
    rows = TB.read_query_rows(spark, folder, multi_line=False)
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType()),
                           T.StructField("c d", T.ArrayType(T.LongType()))])
    assert _rows(TB.typed_rows(rows, schema)) == sorted([(1.0, "x", None), (2.5, None, [1]), (None, None, None),
                                                         (None, None, None)], key=str)
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST|CAST"):
        TB.typed_rows(rows, schema, strict=True).collect()
    for bad in ("{not json", '{"query_result": {"data": null}}', '{"other": 1}'):
        broken = _path(spark)
        spark.createDataFrame([(bad,)], "value string").write.text(broken)
        with pytest.raises(Exception):
            TB.read_query_rows(spark, broken).collect()
