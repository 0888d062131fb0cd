"""Right-closed time bins anchored at the minimum (H8), as ``pd.cut(t, pd.date_range(min, max, freq))``.

Edges are ``lo + k·step`` for ``k = 0..floor((hi − lo)/step)``; bin k is ``(edge_k, edge_k+1]``. The minimum
itself and anything after the last edge get no bin. ``F.window`` is left-closed and epoch-anchored, so it is
not used. ``lo`` and ``hi`` are one global aggregate attached as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import epoch_micros, from_epoch_micros

_UNITS = {"s": 1, "min": 60, "t": 60, "h": 3600, "d": 86400}


def step_micros(bin_size: str) -> int:
    """'1h', '15min', '30s', '1d' → microseconds."""
    s = bin_size.strip().lower()
    num = "".join(ch for ch in s if ch.isdigit() or ch == ".") or "1"
    unit = s[len(num):] if s.startswith(num) else s
    if unit not in _UNITS:
        raise ValueError(f"unsupported bin size: {bin_size}")
    return int(float(num) * _UNITS[unit] * 1_000_000)


def time_bins(df: DataFrame, ts_col: str, bin_size: str = "1h") -> DataFrame:
    """Adds ``bin_start``/``bin_end`` (same kind as ``ts_col``); NULL for rows that fall in no bin.

    Wall-clock (NTZ) timestamps are binned in wall-clock time, independent of the session time zone.
    """
    step = step_micros(bin_size)
    dtype = df.schema[ts_col].dataType
    us = epoch_micros(ts_col, dtype)
    bounds = df.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    lo = bounds.select("lo").scalar()
    hi = bounds.select("hi").scalar()
    n_bins = F.floor((hi - lo) / F.lit(step))
    k = F.ceil((us - lo) / F.lit(step)) - F.lit(1)
    valid = (k >= 0) & (k < n_bins)

    def edge(i):
        return from_epoch_micros(lo + i * F.lit(step), dtype)

    return df.withColumns({
        "bin_start": F.when(valid, edge(k)),
        "bin_end": F.when(valid, edge(k + 1)),
    })
