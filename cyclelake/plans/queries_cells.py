"""Cell scans, filters, search, paging, cycle selection and metadata joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import paging as PG
from ..operators import predicates as P
from ..operators.enrich import join_metadata
from ..operators.features import min_cycles_filter
from ..session import materialise, written_once
from ..sources import fixtures as fx
from ..sources import layout as LY
from ..sources import tables as TB
from .catalog import register

CELL_COLS = ["cell_id", "cell_name", "design_name", "experiment_group", "layer_types", "test_status", "test_year",
             "total_active_mass_g", "nominal_capacity_ah", "regular_cycles", "total_cycles",
             "last_discharge_capacity", "discharge_capacity_retention"]
CYCLE_COLS = fx.CYCLE_COLUMNS


def rounded(df: DataFrame) -> DataFrame:
    """Every double column rounded to 6 places (comparison precision), order kept."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])


def _sql_cols(cols, prefix="") -> str:
    dbl = {"total_active_mass_g", "nominal_capacity_ah", "last_discharge_capacity", "discharge_capacity_retention",
           "discharge_capacity", "charge_capacity", "discharge_energy", "voltage", "temperature",
           "coulombic_efficiency"}
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" if c in dbl else f"{prefix}{c}" for c in cols)


CELLS_SELECT = f"SELECT {_sql_cols(CELL_COLS)} FROM cells_rollup"


@register("cells_scan_min_cycles", CELLS_SELECT + " WHERE regular_cycles > 20")
def cells_scan_min_cycles(spark, sf):
    """A3: required columns checked, cells with more than 20 regular cycles."""
    return rounded(TB.scan_cells(fx.cells_rollup(spark, sf)).select(*CELL_COLS))


@register("cells_filtered", CELLS_SELECT +
          " WHERE total_cycles > 2 AND test_status = 'active' AND CAST(test_year AS VARCHAR) = '2021'")
def cells_filtered(spark, sf):
    """A4 + B1 (equality dict, empty value ignored) + B2 (widget choice compared as text)."""
    cells = TB.scan_cells_interactive(fx.cells_rollup(spark, sf), {"test_status": "active", "design_name": ""})
    return rounded(P.filter_choices(cells, {"test_year": "2021"}).select(*CELL_COLS))


@register("cells_search_text", CELLS_SELECT + " WHERE contains(cell_name, 'gizmo')")
def cells_search_text(spark, sf):
    """Literal substring over the name/type/description/notes columns that exist."""
    return rounded(P.search_cells(fx.cells_rollup(spark, sf), "gizmo").select(*CELL_COLS))


SEARCH_OPS = "test_year:>=2021 nominal_capacity_ah:<30 test_status:act layer_types:=3 bogus:1"


@register("cells_search_ops", CELLS_SELECT + """
 WHERE TRY_CAST(test_year AS DOUBLE) >= 2021 AND TRY_CAST(nominal_capacity_ah AS DOUBLE) < 30
   AND contains(lower(CAST(test_status AS VARCHAR)), 'act') AND TRY_CAST(layer_types AS DOUBLE) = 3""")
def cells_search_ops(spark, sf):
    """Comparison, numeric '=', substring pairs; the unknown column only adds a note."""
    out, notes = P.apply_search(fx.cells_rollup(spark, sf), SEARCH_OPS)
    assert len(notes) == 1 and "'bogus'" in notes[0], notes
    return rounded(out.select(*CELL_COLS))


SEARCH_REGEX = "test_status:complete ^small (ring|gear)"


def _any_column_regex(pattern: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower(CAST({c} AS VARCHAR)), '{pattern}')" for c in CELL_COLS) + ")"


@register("cells_search_regex", CELLS_SELECT +
          " WHERE contains(lower(test_status), 'complete') AND " + _any_column_regex("^small (ring|gear)"))
def cells_search_regex(spark, sf):
    """What is left after the pairs is one regex, OR-ed over every column as text."""
    out, _ = P.apply_search(fx.cells_rollup(spark, sf).select(*CELL_COLS), SEARCH_REGEX)
    return rounded(out)


@register("search_match_summary", f"""
SELECT CAST(count(*) FILTER (WHERE TRY_CAST(test_year AS DOUBLE) >= 2021 AND {_any_column_regex('gizmo')})
            AS BIGINT) AS found,
       CAST(count(*) AS BIGINT) AS total
FROM cells_rollup""")
def search_match_summary(spark, sf):
    """B9: 'found n of m' as one aggregate."""
    return P.match_summary(fx.cells_rollup(spark, sf).select(*CELL_COLS), "test_year:>=2021 gizmo")


@register("cells_page", CELLS_SELECT + " ORDER BY cell_id LIMIT 50 OFFSET 50")
def cells_page(spark, sf):
    """the second page of 50 cells in id order (the limit is the feature)."""
    return rounded(P.page(fx.cells_rollup(spark, sf).select(*CELL_COLS), 1))


def directory_of_cells(spark, sf):
    """The pages of 50 cells in id order; the directory is written once."""
    cells = fx.cells_rollup(spark, sf).select(*CELL_COLS)
    directory = materialise(spark, "cell_pages", fx.input_key(spark, sf), lambda: PG.page_directory(cells, ["cell_id"], 50))
    return PG.Pages(cells, directory, ("cell_id",), 50)


@register("cells_page_by_key", CELLS_SELECT + " ORDER BY cell_id LIMIT 50 OFFSET 150")
def cells_page_by_key(spark, sf):
    """the fourth page of 50 cells as a range of keys, by the directory of pages (the limit is the feature)."""
    return rounded(directory_of_cells(spark, sf).page(3))


@register("cell_page_directory", """
SELECT CAST((place - 1) / 50 AS BIGINT) AS page, cell_id AS first_cell FROM (
  SELECT cell_id, row_number() OVER (ORDER BY cell_id) AS place FROM cells_rollup) WHERE (place - 1) % 50 = 0""")
def cell_page_directory(spark, sf):
    """the first cell of every page of 50."""
    return directory_of_cells(spark, sf).directory.select("page", F.col("first.k0").alias("first_cell"))


@register("filter_choices", """
SELECT DISTINCT column_name, choice FROM (
  SELECT 'design_name' AS column_name, CAST(design_name AS VARCHAR) AS choice FROM cells
  UNION ALL SELECT 'experiment_group', CAST(experiment_group AS VARCHAR) FROM cells
  UNION ALL SELECT 'layer_types', CAST(layer_types AS VARCHAR) FROM cells
  UNION ALL SELECT 'test_status', CAST(test_status AS VARCHAR) FROM cells
  UNION ALL SELECT 'test_year', CAST(test_year AS VARCHAR) FROM cells
  UNION ALL SELECT * FROM (VALUES ('design_name', ''), ('experiment_group', ''), ('layer_types', ''),
                                  ('test_status', ''), ('test_year', '')) v(column_name, choice)
) WHERE choice IS NOT NULL""")
def filter_choices(spark, sf):
    """The choices of the five filter widgets."""
    return P.filter_choice_values(fx.cells(spark, sf))


META = ["cell_name", "design_name", "experiment_group", "layer_types", "test_status", "test_year",
        "total_active_mass_g", "nominal_capacity_ah"]
ENRICHED_SQL = f"SELECT {_sql_cols(CYCLE_COLS, 'y.')}, {_sql_cols(META, 'm.')} FROM cycles y LEFT JOIN cells m USING (cell_id)"


@register("cycles_for_cells", ENRICHED_SQL + " WHERE m.nominal_capacity_ah > 45")
def cycles_for_cells(spark, sf):
    """Cycles of the cells chosen by a predicate (semi join), metadata joined on."""
    cells = fx.cells(spark, sf)
    chosen = cells.filter(F.col("nominal_capacity_ah") > 45).select("cell_id")
    out = TB.cycles_for_cells(fx.cycles(spark, sf), chosen, cells)
    return rounded(out.select(*CYCLE_COLS, *META))


def clustered_cycles(spark, sf):
    """The cycle table clustered by cell, written once."""
    path = written_once(spark, "cycles_clustered", fx.input_key(spark, sf), lambda p: LY.write_clustered(
        fx.cycles(spark, sf), p, "cell_id", ["regular_cycle_number"]))
    return LY.ClusteredTable.read(spark, path, "cell_id")


@register("cycles_clustered_lookup", ENRICHED_SQL + " WHERE m.nominal_capacity_ah > 49")
def cycles_clustered_lookup(spark, sf):
    """Cycles of chosen cells read from the files of their bands, metadata joined on."""
    cells = fx.cells(spark, sf)
    chosen = cells.filter(F.col("nominal_capacity_ah") > 49).select("cell_id")
    out = TB.cycles_for_cells(clustered_cycles(spark, sf), chosen, cells)
    return rounded(out.select(*CYCLE_COLS, *META))


@register("cycles_enriched", ENRICHED_SQL)
def cycles_enriched(spark, sf):
    """Left join of every cycle to the metadata columns it lacks."""
    return rounded(join_metadata(fx.cycles(spark, sf), fx.cells(spark, sf)).select(*CYCLE_COLS, *META))


@register("min_cycles_kept", f"""
SELECT {_sql_cols(CYCLE_COLS)} FROM cycles
WHERE cell_id IN (SELECT cell_id FROM cycles GROUP BY cell_id HAVING count(*) >= 20)""")
def min_cycles_kept(spark, sf):
    """Cycles of cells with at least 20 rows."""
    return rounded(min_cycles_filter(fx.cycles(spark, sf)).select(*CYCLE_COLS))


@register("cells_result_documents", CELLS_SELECT)
def cells_result_documents(spark, sf):
    """A1 (+ A7 as JSON): the cell list written as saved-query result documents (one per partition), read
    back through the envelope reader with an explicit row schema."""
    cells = fx.cells_rollup(spark, sf).select(*CELL_COLS)
    path = written_once(spark, "cell_documents", fx.input_key(spark, sf), lambda p: TB.write_query_result(cells, p))
    return rounded(TB.read_query_result(spark, path, cells.schema, multi_line=False))


@register("cells_result_variant", CELLS_SELECT)
def cells_result_variant(spark, sf):
    """A1 without a row schema: the result documents read as variants, their fields taken by name."""
    cells = fx.cells_rollup(spark, sf).select(*CELL_COLS)
    path = written_once(spark, "cell_documents", fx.input_key(spark, sf), lambda p: TB.write_query_result(cells, p))
    return rounded(TB.typed_rows(TB.read_query_rows(spark, path, multi_line=False), cells.schema, strict=True))


@register("cycles_export_partitioned", f"""
SELECT {_sql_cols(CYCLE_COLS)}, CAST(year(test_date) AS INTEGER) AS test_year
FROM cycles""")
def cycles_export_partitioned(spark, sf):
    """Cycles exported as parquet partitioned by test year, read back whole."""
    by_year = fx.cycles(spark, sf).withColumn("test_year", F.year("test_date"))
    path = written_once(spark, "cycles_by_year", fx.input_key(spark, sf),
                        lambda p: TB.write_table(by_year, p, partition_by=["test_year"], mode="overwrite"))
    return rounded(TB.read_table(spark, path).select(*CYCLE_COLS, "test_year"))


@register("cycles_export_sorted", f"""
SELECT {_sql_cols(CYCLE_COLS)}, CAST(year(test_date) AS INTEGER) AS test_year
FROM cycles""")
def cycles_export_sorted(spark, sf):
    """As cycles_export_partitioned, with a bound on the number of files and rows of a file, sorted by cell and cycle."""
    by_year = fx.cycles(spark, sf).withColumn("test_year", F.year("test_date"))
    path = written_once(spark, "cycles_sorted", fx.input_key(spark, sf), lambda p: LY.write_sorted(
        by_year, p, ["test_year"], ["cell_id", "regular_cycle_number"]))
    return rounded(TB.read_table(spark, path).select(*CYCLE_COLS, "test_year"))
