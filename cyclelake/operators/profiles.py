"""Column profiles that follow a growing table (D4-D6, D11): one stored state per file and column, merged on demand.

A state holds counts, the mean, the sum of squared deviations and the extremes of a column's finite values in one file, so a
profile of the whole table is a merge of few small rows, and new files alone are read. Files are taken as written once: a file
that is changed under its name keeps its old state, one that is gone no longer counts. A file without rows has no state.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import null_infinity
from . import schema as S

STATE = ("file string, column_name string, rows long, nulls long, infs long, n long, mean double, squares double, "
         "least double, most double")


_LOCAL = re.compile("^file:/+")  # a scan and its list of files write this differently


def _names(files: Iterable[str]) -> set[str]:
    return {_LOCAL.sub("file:/", f) for f in files}


def file_states(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The states of a table that is read from files, ``columns`` being numeric (default: all that are)."""
    columns = list(columns) if columns is not None else S.numeric_columns(df)
    values = df.select(F.regexp_replace("_metadata.file_path", _LOCAL.pattern, "file:/").alias("file"), *[F.col(c).cast("double").alias(c) for c in columns])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x = null_infinity(c)
        n = F.count(x)
        aggs.append(F.struct(F.lit(c).alias("column_name"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"),
                             (F.count(c) - n).alias("infs"), n.alias("n"), F.avg(x).alias("mean"),
                             (F.var_pop(x) * n).alias("squares"), F.min(x).alias("least"), F.max(x).alias("most")).alias(f"_{i}"))
    wide = values.groupBy("file").agg(*aggs)
    return wide.select("file", "rows", F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))]))).select(
        *[c.split()[0] for c in STATE.split(", ")])


def update_states(df: DataFrame, states_path: str, columns: Sequence[str] | None = None) -> int:
    """Add the states of ``df``'s files that ``states_path`` lacks; only these files are read. Returns their number.

    The names of files pass through the driver, which lists them for the scan anyway.
    """
    spark = df.sparkSession
    current = _names(df.inputFiles())
    try:
        stored = spark.read.schema(STATE).parquet(states_path)
        known = {r[0] for r in stored.select("file").distinct().collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = set()
    fresh = sorted(current - known)
    if fresh:
        file_states(spark.read.schema(df.schema).parquet(*fresh), columns).write.mode("append").parquet(states_path)
    return len(fresh)


def merged_profile(spark: SparkSession, states_path: str, files: Sequence[str]) -> DataFrame:
    """The profile of ``files``, as :func:`~cyclelake.operators.summary.column_profile` gives it, with ``completeness``.

    A state that was stored twice (two updates at once) counts once.
    """
    names = spark.createDataFrame([(f,) for f in sorted(_names(files))], "file string")
    states = spark.read.schema(STATE).parquet(states_path).join(names, "file", "left_semi").dropDuplicates(
        ["file", "column_name"])
    total = states.groupBy("column_name").agg((F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    # deviations are moved to the common mean before they are added: sums of squares would cancel
    moved = F.col("squares") + F.col("n") * F.pow(F.col("s.mean") - F.col("t.mean"), F.lit(2))
    joined = states.alias("s").join(total.alias("t"), "column_name")
    n, rows = F.sum("n"), F.sum("rows")
    return joined.groupBy("column_name").agg(
        rows.alias("total_count"), F.sum("nulls").alias("null_count"), F.sum("infs").alias("inf_count"),
        F.min("least").alias("min"), F.max("most").alias("max"), F.first("t.mean").alias("mean"),
        F.sqrt(F.sum(moved) / F.nullif(n, F.lit(0))).alias("std"), ((rows - F.sum("nulls")) / rows).alias("completeness"))
