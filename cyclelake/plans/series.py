"""Plot series extraction (B20, B21): the data a chart needs, as a projection. Drawing is not built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeriesConfig:
    x: str = "regular_cycle_number"
    y: str = "discharge_capacity"
    y2: str | None = None
    group: str = "cell_id"
    y_min: float | None = None
    y_max: float | None = None
    x_min: float | None = None
    x_max: float | None = None

    def validate(self, df: DataFrame) -> list[str]:
        """Columns exist and axis minima are below maxima."""
        errors = [f"column '{c}' not found" for c in (self.x, self.y, self.group, self.y2)
                  if c is not None and c not in df.columns]
        for lo, hi, axis in ((self.x_min, self.x_max, "x"), (self.y_min, self.y_max, "y")):
            if lo is not None and hi is not None and lo >= hi:
                errors.append(f"{axis} axis minimum must be below its maximum")
        return errors


# The reference's four preset series.
PRESETS = {
    "capacity_retention": SeriesConfig(y="discharge_capacity"),
    "efficiency": SeriesConfig(y="coulombic_efficiency", y_min=95, y_max=100),
    "specific_capacity": SeriesConfig(y="discharge_capacity_specific_mAh_g"),
    "dual_axis_capacity_efficiency": SeriesConfig(y="discharge_capacity", y2="coulombic_efficiency"),
}


def series(df: DataFrame, config: SeriesConfig) -> DataFrame:
    """(group, x, y[, y2]) rows. Axis limits set only when both ends are given; they describe the view, so rows
    outside are kept and flagged (``in_view``) rather than dropped."""
    errors = config.validate(df)
    if errors:
        raise ValueError("; ".join(errors))
    cols = [F.col(config.group), F.col(config.x), F.col(config.y)] + ([F.col(config.y2)] if config.y2 else [])
    out = df.select(*cols)
    conds = []
    if config.x_min is not None and config.x_max is not None:
        conds.append(F.col(config.x).between(config.x_min, config.x_max))
    if config.y_min is not None and config.y_max is not None:
        conds.append(F.col(config.y).between(config.y_min, config.y_max))
    if conds:
        pred = conds[0]
        for c in conds[1:]:
            pred = pred & c
        out = out.withColumn("in_view", F.coalesce(pred, F.lit(False)))
    return out
