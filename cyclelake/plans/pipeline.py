"""Composed pipelines (J1-J5, E20) as single plans.

``process_cycle_data`` is the feature pipeline: clean (B12) → minimum history (B14) → cycle features,
normalisations, degradation, outliers, rolling statistics (E1-E19) → metadata join (C1) → ±inf cleanup (H2).
Building a plan runs small size checks (is any cell over the hot-group threshold), which bring back one row at most.
``load_and_process`` returns the frames, the rule results, their report and the counts; they share one written feature
table.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_infinities
from ..operators import features as FT
from ..operators import quality as Q
from ..operators.enrich import join_metadata, semi_join_ids
from ..operators.predicates import filter_equals
from ..operators.skew import HotKeys, hot_keys
from ..session import checkpoint_dir
from ..sources.layout import ClusteredTable
from ..sources.tables import chosen_cycles, clean_cycles, scan_cells


@dataclass(frozen=True)
class ProcessingConfig:
    """Switches of the feature pipeline (reference defaults). Unknown method names are skipped."""

    add_normalizations: bool = True
    add_degradation_features: bool = True
    add_rolling_features: bool = True  # the reference calls this switch "statistical features"
    add_cycle_features: bool = True
    normalization_methods: Sequence[str] = FT.DEFAULT_NORM_METHODS
    min_cycles_required: int = FT.MIN_CYCLES
    outlier_detection: bool = True
    outlier_threshold: float = FT.OUTLIER_FACTOR
    keep_all_if_no_cell_qualifies: bool = False  # quirk Q4, off by default

    def spec(self) -> FT.FeatureSpec:
        methods = tuple(m for m in self.normalization_methods if m in FT.NORM_METHODS)
        return FT.FeatureSpec(
            cycle=self.add_cycle_features,
            normalise=methods if self.add_normalizations else (),
            degrade=self.add_degradation_features,
            rolling=self.add_rolling_features,
            outliers=self.outlier_detection,
            outlier_factor=self.outlier_threshold,
        )


def create_processing_config(normalization_methods: Sequence[str] | None = None, min_cycles: int = FT.MIN_CYCLES,
                             add_degradation: bool = True, add_rolling: bool = True) -> ProcessingConfig:
    methods = tuple(m for m in (normalization_methods or ()) if m in FT.NORM_METHODS)
    return ProcessingConfig(normalization_methods=methods or FT.DEFAULT_NORM_METHODS, min_cycles_required=min_cycles,
                            add_degradation_features=add_degradation, add_rolling_features=add_rolling)


def process_cycle_data(cycles: DataFrame, cells: DataFrame | None = None, config: ProcessingConfig | None = None,
                       group_by_cell: bool = True, hot: HotKeys | None = None) -> DataFrame:
    """J1 (``group_by_cell=False``: E20, whole-table statistics). ``hot``: the hot cells of ``cycles`` or of a larger table.

    The features leave the rows dealt by cell, and so the metadata join doesn't exchange the wide rows again.
    """
    config = config or ProcessingConfig()
    data = clean_cycles(cycles)
    spec = config.spec()
    if group_by_cell and config.keep_all_if_no_cell_qualifies:
        data = FT.min_cycles_filter(data, config.min_cycles_required, True)
    elif group_by_cell:
        spec = replace(spec, min_cycles=config.min_cycles_required)
    hot = hot_keys(data, "cell_id", spec.hot_rows) if hot is None else hot
    out = FT.cycle_features(data, spec, by_cell=group_by_cell, hot=hot)
    if cells is not None:
        out = join_metadata(out, cells, hot=hot)
    return clean_infinities(out)


def load_and_process(cells: DataFrame, cycles: DataFrame, cell_ids: DataFrame | Sequence[int] | None = None,
                     filters: dict | None = None, config: ProcessingConfig | None = None, validate: bool = True) -> dict:
    """Cells (by ids and equality filters) → their cycles → features → rules → report, and ``counts``: rows and
    columns of each frame. The features are written once, and the rules are measured by that write; the report and the caller
    read the results. The files stay in the checkpoint folder until that is cleaned.
    """
    chosen_cells = filter_equals(scan_cells(cells), filters or {})
    if cell_ids is not None:
        chosen_cells = semi_join_ids(chosen_cells, cell_ids)
    data = clean_cycles(cycles)
    hot = hot_keys(data, "cell_id")
    chosen_cycles = semi_join_ids(data, chosen_cells.select("cell_id"), hot=hot)
    built = process_cycle_data(chosen_cycles, chosen_cells, config, hot=hot)
    spark = cells.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"features-{uuid.uuid4().hex}")
    if validate:
        rules = Q.validate_while_writing(built, Q.battery_standards(), path)
    else:
        built.write.parquet(path)
    out = {"cells": chosen_cells, "cycles": spark.read.schema(built.schema).parquet(path)}
    if validate:
        out["rules"] = rules
        out["report"] = Q.report(rules)
    tables = [out[name].agg(F.lit(name).alias("frame"), F.count(F.lit(1)).alias("rows"),
                            F.lit(len(out[name].columns)).alias("columns")) for name in ("cells", "cycles", "rules") if name in out]
    out["counts"] = reduce(DataFrame.unionByName, tables)
    return out


def selected_cells_cycles(cells: DataFrame, cycles: DataFrame | ClusteredTable,
                          cell_ids: DataFrame | Sequence[int]) -> DataFrame:
    """Cycles of the selected cells with the loader's normalisations (E10, E11), the cells' metadata
    and specific capacity/energy (H3, H4)."""
    chosen = chosen_cycles(cycles, cell_ids)
    normed = FT.cycle_features(chosen, FT.FeatureSpec(basic_norm=True))
    base_caps = [c for c in chosen.columns if "capacity" in c.lower()]
    base_energy = [c for c in chosen.columns if "energy" in c.lower()]
    enriched = join_metadata(normed, semi_join_ids(cells, cell_ids))
    return FT.specific_metrics(enriched, capacity_cols=base_caps, energy_cols=base_energy)
