"""Per-cell Python rules as mergeable states, against a brute force that gathers each cell."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cyclelake.operators import cellrules

RULE = cellrules.variety_rule("x", 2.0, 8, 2.5)


def brute(rows):
    cells = {}
    for cell, x in rows:
        cells.setdefault(cell, []).extend([] if x is None else [x])
    out = []
    for cell, values in cells.items():
        bins = Counter(min(7, max(0, math.floor(v / 2.0))) for v in values)
        entropy = -sum(n / len(values) * math.log2(n / len(values)) for n in bins.values())
        out.append((cell, "value_variety", bool(values) and entropy >= 2.5, f"{len(values)} values in {len(bins)} bins"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("states", [10_000, 3])
def test_verdicts_equal_gathered_cells(spark, monkeypatch, states):
    monkeypatch.setattr(cellrules, "MAX_STATES", states)
    rows = [(0, float(i % 17) - 1) for i in range(5000)]  # a hot cell in every task
    rows += [(c, float((c * 7 + i) % (c + 1))) for c in range(1, 60) for i in range(12)]
    rows += [(None, 1.0), (None, 9.0), (77, None), (78, None), (78, 3.0), (79, 1e9), (79, -1e9)] + [(80, 5.0)] * 40
    df = spark.createDataFrame(rows, "cell_id long, x double").repartition(9).withColumn("state", F.lit("clash"))
    got = cellrules.check_cells(df, RULE)
    assert got.columns == ["cell_id", "rule", "is_valid", "details"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_a_hot_cell_leaves_one_state_per_task(spark):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("cell_id"), (F.col("id") % 16).cast("double").alias("x")).repartition(6)
    states = df.mapInArrow(cellrules._partial(RULE, "cell_id"), "cell_id long, state binary")
    assert 1 <= states.count() <= 6
    assert cellrules.check_cells(df, RULE).count() == 1


def test_no_rows_no_verdicts(spark):
    assert cellrules.check_cells(spark.createDataFrame([], "cell_id long, x double"), RULE).collect() == []
