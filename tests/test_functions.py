"""Scalar helpers, units, time bins, schema helpers, sources: hand-built rows the driver tables lack."""

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cyclelake.functions import columns as C
from cyclelake.functions import timebins, units
from cyclelake.operators import schema as S
from cyclelake.sources import tables as TB


def test_safe_divide_and_infinity_cleanup(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (4.0, 2.0), (float("inf"), 1.0), (float("nan"), 1.0)],
                               "n double, d double")
    got = df.select(C.safe_divide("n", "d").alias("s"), C.null_infinity("n").alias("c")).collect()
    assert [r.s for r in got[:3]] == [0.0, 0.0, 2.0]
    assert got[3].c is None and math.isnan(got[4].c)


def test_ieee_divide(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0)], "n double, d double")
    got = [r.q for r in df.select(C.ieee_divide("n", "d").alias("q")).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and math.isnan(got[2]) and got[3] is None


def test_units():
    assert units.factor("kWh", "Wh") == 1000.0
    assert units.factor("Ah", "C") == pytest.approx(3600.0)  # quirk Q11 fixed: 1 Ah = 3600 C
    with pytest.raises(ValueError):
        units.factor("Wh", "Ah")


def test_units_per_row(spark):
    df = spark.createDataFrame([(1.0, "kWh"), (3600.0, "J"), (2.0, "wh")], "v double, u string")
    got = [r.wh for r in units.convert_by_unit_column(df, "v", "u", "Wh", "wh").orderBy("v").collect()]
    assert got == pytest.approx([1000.0, 2.0, 1.0], rel=1e-9)
    bad = spark.createDataFrame([(1.0, "furlong")], "v double, u string")
    with pytest.raises(Exception, match="Cannot convert unit furlong"):
        units.convert_by_unit_column(bad, "v", "u", "Wh", "wh").collect()


def test_time_bins_equal_pandas_cut(spark):
    ts = pd.Series(pd.to_datetime("2024-01-01") + pd.to_timedelta(
        [0, 17, 60, 61, 119, 120, 121, 250, 301, 359], unit="min"))
    ref = pd.cut(ts, bins=pd.date_range(ts.min(), ts.max(), freq="1h"))
    df = spark.createDataFrame([(i, t.to_pydatetime()) for i, t in enumerate(ts)], "i long, ts timestamp_ntz")
    got = timebins.time_bins(df, "ts", "1h").orderBy("i").collect()
    for r, iv in zip(got, ref):
        if pd.isna(iv):
            assert r.bin_start is None
        else:
            assert pd.Timestamp(r.bin_start) == iv.left and pd.Timestamp(r.bin_end) == iv.right


def test_snake_case_and_collisions(spark):
    assert S.snake_case("Discharge Capacity") == "discharge_capacity"
    assert S.snake_case("cellID-Name") == "cell_id_name"
    assert S.snake_case("  Test  Date ") == "test_date"
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a-b` int")
    with pytest.raises(ValueError):
        S.normalise_column_names(df)


def test_schema_report(spark):
    df = spark.createDataFrame([], "cell_id long")
    res = S.schema_report(df, ["cell_id", "cell_name"]).first()
    assert not res["valid"] and res["errors"] == ["missing required columns: cell_name", "no rows"] and res["rows"] == 0


def test_query_result_document(spark, tmp_path):
    doc = {"query_result": {"data": {"columns": [], "rows": [{"cell_id": 1, "cell_name": "a"},
                                                            {"cell_id": 2, "cell_name": "b"}]}}}
    p = tmp_path / "r.json"
    p.write_text(json.dumps(doc))
    df = TB.read_query_result(spark, str(p))
    assert sorted(r.cell_id for r in df.collect()) == [1, 2]
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"other": 1}))
    with pytest.raises(ValueError):
        TB.read_query_result(spark, str(bad))


def test_stack_and_write(spark, tmp_path):
    a = spark.createDataFrame([(1, 1.0)], "cell_id long, x double")
    b = spark.createDataFrame([(2, "n")], "cell_id long, note string")
    s = TB.stack([a, b])
    assert set(s.columns) == {"cell_id", "x", "note"} and s.count() == 2
    TB.write_table(s, str(tmp_path / "out"), partition_by=["cell_id"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_integer_bounds_keep_their_meaning(spark):
    from cyclelake.operators import predicates as P
    df = spark.createDataFrame([(i,) for i in range(10)], "n long")
    for q, expect in [("n:>=2.5", [3, 4, 5, 6, 7, 8, 9]), ("n:>2.5", [3, 4, 5, 6, 7, 8, 9]), ("n:<2.5", [0, 1, 2]),
                      ("n:<=2.5", [0, 1, 2]), ("n:=2.5", []), ("n:=3", [3]), ("n:<-1", [])]:
        got = sorted(r.n for r in P.apply_search(df, q)[0].collect())
        assert got == expect, q


def test_unit_labels_are_exact_first_and_never_guessed():
    assert units.factor("mWh", "Wh") == 0.001 and units.factor("MWh", "Wh") == 1e6 and units.factor("mwh", "Wh") == 1e6
    assert units.factor("KWH", "wh") == 1000.0 and units.factor("mW", "W") == 0.001
    with pytest.raises(ValueError, match="Ambiguous"):
        units.factor("MWH", "Wh")


def test_ambiguous_unit_rows_give_null_when_not_strict(spark):
    df = spark.createDataFrame([(1.0, "MWH"), (2.0, "mWh"), (3.0, "KWH"), (4.0, None)], "v double, u string")
    got = units.convert_by_unit_column(df, "v", "u", "Wh", "wh", strict=False).orderBy("v").collect()
    assert [r.wh for r in got] == [None, 0.002, 3000.0, None]


@pytest.mark.parametrize("name,want", [("Cap2Max", "cap2max"), ("dischargeCapacity", "discharge_capacity"),
                                       (" Cell Name--ID ", "cell_name_id"), ("ABCDef", "abcdef"), ("__a__b_", "a_b"),
                                       ("test\tDate", "test_date"), ("", ""), ("xY2Z", "x_y2z")])
def test_snake_case_by_hand(name, want):
    from cyclelake.operators.schema import snake_case

    assert snake_case(name) == want


def test_capacity_pairs_by_hand(spark):
    from cyclelake.operators.schema import charge_discharge_pairs

    df = spark.createDataFrame([], "Charge_Capacity double, discharge_capacity double, charge_energy double, "
                                   "capacity double, discharge_capacity_2 double")
    assert charge_discharge_pairs(df) == [("Charge_Capacity", "discharge_capacity"), ("Charge_Capacity", "discharge_capacity_2")]


def test_broken_result_documents_fail(spark, tmp_path):
    from pyspark.sql import types as T
    from cyclelake.sources.tables import read_query_result, write_query_result

    schema = T.StructType([T.StructField("a", T.LongType())])
    good = '{"query_result": {"data": {"rows": [{"a": 1}]}}}'
    for k, bad in enumerate(['{"query_result": {}}', '{"error": "x"}', '{"query_result": {"data": {"ro']):
        path = tmp_path / f"{k}.json"
        path.write_text(good + "\n" + bad + "\n")
        for given in (schema, None):
            with pytest.raises(Exception):
                read_query_result(spark, str(path), given, multi_line=False).collect()
    path = tmp_path / "empty.json"
    path.write_text(good + '\n{"query_result": {"data": {"rows": []}}}\n')
    assert [r.a for r in read_query_result(spark, str(path), schema, multi_line=False).collect()] == [1]
    out = str(tmp_path / "out")
    write_query_result(spark.range(25).toDF("a").repartition(2), out, rows_per_document=4)
    assert spark.read.json(out).count() >= 7
    assert sorted(r.a for r in read_query_result(spark, out, schema, multi_line=False).collect()) == list(range(25))


def test_free_text_regex_keeps_its_classes(spark):
    from cyclelake.operators.predicates import apply_search

    df = spark.createDataFrame([("123",), ("Abc",)], "name string")
    assert [r.name for r in apply_search(df, r"^\D+$")[0].collect()] == ["Abc"]
    assert [r.name for r in apply_search(df, "aBC")[0].collect()] == ["Abc"]
