"""Unit conversion (H6) for columns: a fixed unit, or a per-row unit column with a small factor table.

Factors are to the base unit of each family (Wh, Ah, W). The reference inverts the coulomb factors (quirk
Q11); here 1 C = 1/3600 Ah. A label is taken as written first (``mW`` is milli, ``MW`` mega; the all-small ``mwh``,
``mj``, ``mw`` keep the reference's meaning, mega); otherwise its case is ignored, and a label that could then mean
several units is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Conversion factors to the family's base unit.
ENERGY = {"Wh": 1.0, "kWh": 1000.0, "MWh": 1000000.0, "mwh": 1000000.0, "mWh": 0.001, "J": 1 / 3600.0,
          "kJ": 1000 / 3600.0, "MJ": 1000000 / 3600.0, "mj": 1000000 / 3600.0, "mJ": 0.001 / 3600.0}
CAPACITY = {"Ah": 1.0, "mAh": 0.001, "C": 1 / 3600.0, "mC": 0.001 / 3600.0}
POWER = {"W": 1.0, "kW": 1000.0, "MW": 1000000.0, "mw": 1000000.0, "mW": 0.001, "hp": 745.7}
FAMILIES = {"energy": ENERGY, "capacity": CAPACITY, "power": POWER}
_EXACT = {label: (family, value) for family, table in FAMILIES.items() for label, value in table.items()}


def _folded() -> dict[str, tuple[str, float]]:
    """Small-letter forms that can mean one unit only."""
    meanings: dict[str, set] = {}
    for label, unit in _EXACT.items():
        meanings.setdefault(label.lower(), set()).add(unit)
    return {form: next(iter(units)) for form, units in meanings.items() if len(units) == 1}


def _lookup(unit: str) -> tuple[str, float]:
    found = _EXACT.get(unit) or _folded().get(unit.lower())
    if found is None:
        known = any(label.lower() == unit.lower() for label in _EXACT)
        raise ValueError(f"{'Ambiguous' if known else 'Unknown'} unit: {unit}")
    return found


def factor(from_unit: str, to_unit: str) -> float:
    f_fam, f_val = _lookup(from_unit)
    t_fam, t_val = _lookup(to_unit)
    if f_fam != t_fam:
        raise ValueError(f"Cannot convert from {from_unit} to {to_unit}")
    return f_val / t_val


def convert(col: str | Column, from_unit: str, to_unit: str) -> Column:
    """A column whose unit is fixed: one multiplication, folded into the projection."""
    c = F.col(col) if isinstance(col, str) else col
    return c * F.lit(factor(from_unit, to_unit))


def factor_table(spark: SparkSession) -> DataFrame:
    """Labels as written (key ``=label``) and unambiguous labels in small letters (key ``~label``): about 40 rows."""
    rows = [(mark + label, family, value) for mark, table in (("=", _EXACT), ("~", _folded()))
            for label, (family, value) in table.items()]
    return spark.createDataFrame(rows, "unit string, family string, to_base double")


def convert_by_unit_column(df: DataFrame, value_col: str, unit_col: str, to_unit: str, out_col: str,
                           strict: bool = True) -> DataFrame:
    """Per-row units: join the factor table (broadcast; its size is fixed) on the label.

    Unknown or ambiguous units, or another family, give NULL, or an error inside the query when ``strict``.
    """
    family, to_base = _lookup(to_unit)
    table = factor_table(df.sparkSession).filter(F.col("family") == family).select(
        F.col("unit").alias("_unit_key"), F.col("to_base").alias("_to_base"))
    unit = F.col(unit_col)
    key = F.when(unit.isin(list(_EXACT)), F.concat(F.lit("="), unit)).otherwise(F.concat(F.lit("~"), F.lower(unit)))
    joined = df.withColumn("_unit_key", key).join(F.broadcast(table), "_unit_key", "left")
    value = F.col(value_col) * F.col("_to_base") / F.lit(to_base)
    if strict:
        message = F.concat(F.lit("Cannot convert unit "), unit, F.lit(f" to {to_unit}"))
        value = F.when(unit.isNotNull() & F.col("_to_base").isNull(), F.raise_error(message).cast("double")).otherwise(value)
    return joined.withColumn(out_col, value).drop("_unit_key", "_to_base")
