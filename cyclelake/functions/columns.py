"""Scalar Column helpers (H1, H2, H13). All built-in expressions: they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.schema import FLOAT_TYPES


def _ntz_epoch() -> Column:
    """1970-01-01 00:00 as a TIMESTAMP_NTZ literal (a Python datetime literal would be zone-bound)."""
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(numerator: str | Column, denominator: str | Column, default: float = 0.0) -> Column:
    """H1: n / d when d != 0, else ``default``. A NULL denominator also gives ``default``."""
    n, d = col(numerator), col(denominator)
    return F.when(d != 0, n / d).otherwise(F.lit(default))


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """n / d, NULL when d is 0 or NULL (quirk Q16: no ±inf or NaN from a zero denominator)."""
    return F.try_divide(col(numerator), col(denominator))


def positive_or_null(c: str | Column) -> Column:
    """The value when it is > 0, else NULL: the reference only divides by a reference value that is > 0."""
    v = col(c)
    return F.when(v > 0, v)


def is_infinite(c: str | Column) -> Column:
    v = col(c)
    return v.isin(float("inf"), float("-inf"))


def null_infinity(c: str | Column) -> Column:
    """H2: ±inf becomes NULL; NaN and finite values are kept."""
    v = col(c)
    return F.when(is_infinite(v), F.lit(None).cast("double")).otherwise(v)


def clean_infinities(df: DataFrame) -> DataFrame:
    """H2 over every float column, in one projection."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)}
    return df.select(*[null_infinity(c).cast(df.schema[c].dataType).alias(c) if c in floats else F.col(c)
                       for c in df.columns])


def r6(c: str | Column) -> Column:
    """Round to 6 places for comparison with the SQL oracle: ``floor(x·1e6 + 0.5) / 1e6`` for |x| < 1e9.

    Plain IEEE arithmetic gives the same double on every engine, where ``round`` does not (Spark rounds the
    exact binary value, other engines round x·10^6). NaN, ±inf and |x| ≥ 1e9 pass through unchanged.
    """
    x = col(c)
    return F.when(F.abs(x) < F.lit(1e9), F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).otherwise(x)


def ieee_divide(numerator: str | Column, denominator: str | Column) -> Column:
    """n / d with IEEE results for a zero denominator (±inf, NaN for 0/0), as Polars and NumPy give them.

    ANSI mode raises on division by zero, so the zero case is spelled out; NULL inputs give NULL.
    """
    n, d = col(numerator), col(denominator)
    zero = (F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))))
    return F.when(n.isNull() | d.isNull(), F.lit(None).cast("double")).when(d == 0, zero).otherwise(n / d)


def epoch_micros(c: str | Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970-01-01 00:00 without any time-zone shift for wall-clock (NTZ) timestamps.

    ``unix_micros(ntz.cast("timestamp"))`` would go through the session time zone and lose or gain an hour
    across daylight-saving changes; ``timestamp_diff`` on NTZ values does not.
    """
    x = col(c)
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", _ntz_epoch(), x)
    if isinstance(dtype, T.DateType):
        return F.unix_date(x).cast("long") * F.lit(86_400_000_000)
    return F.unix_micros(x)


def from_epoch_micros(micros: Column, dtype: T.DataType) -> Column:
    """Inverse of :func:`epoch_micros`, giving a value of the same kind (NTZ stays NTZ)."""
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return F.timestamp_add("MICROSECOND", micros, _ntz_epoch())
    return F.timestamp_micros(micros)
