"""Whole-column outlier tests (H9-H11), exact and without gathering a column into one task.

Quartiles and medians come from :func:`~cyclelake.operators.ordering.quantiles` (linear interpolation,
NumPy's default), which narrows brackets around the wanted ranks. The one-row statistics are attached to the rows as
scalar subqueries, so no join and no single-partition window over rows is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import quantiles

# The reference's thresholds.
IQR_FACTOR = 1.5
ZSCORE_LIMIT = 3.0
MODIFIED_Z_LIMIT = 3.5
MODIFIED_Z_SCALE = 0.6745


def _scalar(df: DataFrame, expr: Column) -> Column:
    return df.agg(expr).scalar()


def iqr_outliers(df: DataFrame, column: str, factor: float = IQR_FACTOR, keys: Sequence[str] = ()) -> DataFrame:
    """H9: ``{column}_outlier`` = value outside [q1 − f·iqr, q3 + f·iqr], linear quartiles; NULL stays NULL."""
    q = quantiles(df, list(keys), [column], [0.25, 0.75], "linear")
    x = F.col(column)
    if keys:
        joined = df.join(q, list(keys), "left")
        q1, q3 = F.col(f"{column}_p25"), F.col(f"{column}_p75")
    else:
        joined = df
        q1, q3 = _scalar(q, F.first(f"{column}_p25")), _scalar(q, F.first(f"{column}_p75"))
    iqr = q3 - q1
    flag = (x < q1 - F.lit(factor) * iqr) | (x > q3 + F.lit(factor) * iqr)
    out = joined.withColumn(f"{column}_outlier", flag)
    return out.drop(f"{column}_p25", f"{column}_p75") if keys else out


def zscore_outliers(df: DataFrame, column: str, limit: float = ZSCORE_LIMIT) -> DataFrame:
    """|x − mean| / population std > limit (std 0 → NULL flag)."""
    x = F.col(column)
    mean = _scalar(df, F.avg(x))
    std = _scalar(df, F.stddev_pop(x))
    return df.withColumn(f"{column}_outlier", F.abs(F.try_divide(x - mean, std)) > F.lit(limit))


def modified_zscore_outliers(df: DataFrame, column: str, limit: float = MODIFIED_Z_LIMIT) -> DataFrame:
    """|0.6745 (x − median) / MAD| > limit with MAD = median |x − median|; MAD 0 → NULL flag."""
    x = F.col(column)
    med_df = quantiles(df, [], [column], [0.5], "linear")
    median = _scalar(med_df, F.first(f"{column}_p50"))
    dev = df.select(F.abs(x - median).alias("_dev"))
    mad = _scalar(quantiles(dev, [], ["_dev"], [0.5], "linear"), F.first("_dev_p50"))
    score = F.try_divide(F.lit(MODIFIED_Z_SCALE) * (x - median), mad)
    return df.withColumn(f"{column}_outlier", F.abs(score) > F.lit(limit))


def detect_outliers(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    if method == "iqr":
        return iqr_outliers(df, column)
    if method == "zscore":
        return zscore_outliers(df, column)
    if method == "modified_zscore":
        return modified_zscore_outliers(df, column)
    raise ValueError(f"Unknown outlier detection method: {method}")
