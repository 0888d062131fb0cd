"""Sources and sinks (A1-A7), cleaning (B12) and stacking (G1).

The reference pulls rows from saved queries over HTTP, one request per cell. Here the data is read as
tables: parquet (tested), JDBC with a partition column, or exported saved-query result documents. Every
reader returns a lazy DataFrame; cell selection is a predicate or a semi join, never a per-cell loop.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.enrich import join_metadata, semi_join_ids
from ..operators.predicates import filter_equals
from ..operators.schema import require_columns
from .layout import ClusteredTable

CELL = "cell_id"
# Thresholds used by the reference's cell scans.
MIN_REGULAR_CYCLES = 20
MIN_TOTAL_CYCLES = 2


def read_query_result(spark: SparkSession, path: str, rows_schema: T.StructType | None = None,
                      multi_line: bool = True) -> DataFrame:
    """A1: saved-query result documents ``{"query_result": {"data": {"rows": [...]}}}`` → one row per entry.

    Every document must parse and hold ``query_result.data``; one that doesn't fails the query that reads it. A
    document without rows gives none. Pass ``rows_schema`` in production (inference reads the files twice and may
    guess types differently). ``multi_line=True`` reads one (pretty-printed) document per file, as an export
    produces; ``multi_line=False`` reads JSON lines, one document per line, so many documents share a file.
    """
    reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    if rows_schema is not None:
        envelope = T.StructType([T.StructField("query_result", T.StructType([
            T.StructField("data", T.StructType([T.StructField("rows", T.ArrayType(rows_schema))]))]))])
        reader = reader.schema(envelope)
    raw = reader.json(path)
    names = raw.schema.names
    if "query_result" not in names:
        raise ValueError("query result document has no 'query_result'")
    qr = raw.schema["query_result"].dataType
    if not isinstance(qr, T.StructType) or "data" not in qr.names:
        raise ValueError("query result document has no 'query_result.data'")
    data = qr["data"].dataType
    if not isinstance(data, T.StructType) or "rows" not in data.names:
        if rows_schema is not None:
            return spark.createDataFrame([], rows_schema)
        raise ValueError("query result document has no rows")
    kind = data["rows"].dataType
    broken = F.raise_error(F.lit("query result document has no 'query_result.data'")).cast(kind)
    rows = F.coalesce(F.col("query_result.data.rows"), F.array().cast(kind))
    return raw.select(F.inline(F.when(F.col("query_result.data").isNull(), broken).otherwise(rows)))


def read_query_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A1 without a row schema: one VARIANT column ``row`` per entry of the documents.

    The files are read once and nothing is guessed, so rows may differ in fields and types. Broken documents fail the query as in
    :func:`read_query_result`. ``multi_line=True`` holds one file's document in a task at a time.
    """
    text = spark.read.text(path, wholetext=multi_line).where(F.trim("value") != "")
    docs = text.select(F.parse_json("value").alias("doc"))
    data = F.variant_get("doc", "$.query_result.data", "variant")
    rows = F.variant_get("doc", "$.query_result.data.rows", "array<variant>")
    broken = F.raise_error(F.lit("query result document has no 'query_result.data'")).cast("array<variant>")
    missing = data.isNull() | F.is_variant_null(data)
    return docs.select(F.explode(F.when(missing, broken).otherwise(F.coalesce(rows, F.array().cast("array<variant>")))).alias("row"))


def typed_rows(rows: DataFrame, schema: T.StructType, strict: bool = False) -> DataFrame:
    """The fields of ``schema`` out of :func:`read_query_rows`. An absent field is NULL; a value of another type is NULL, or
    fails the query if ``strict``."""
    value = F.variant_get if strict else F.try_variant_get
    return rows.select(*[value("row", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in schema.fields])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A2: a table from files (parquet by default)."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, partition_column: str = CELL,
              partitions: int = 64, properties: dict | None = None) -> DataFrame:
    """A2: a database table read in ``partitions`` parallel ranges of ``partition_column``.

    ``lower`` and ``upper`` are about its least and largest value: they set the ranges, and rows outside them fall in the first
    and last. (Untested here: it needs a database.)
    """
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})


def scan_cells(cells: DataFrame, min_regular_cycles: int = MIN_REGULAR_CYCLES) -> DataFrame:
    """A3: require ``cell_id`` and ``cell_name``; keep ``regular_cycles > min`` when that column exists."""
    require_columns(cells, [CELL, "cell_name"])
    if "regular_cycles" in cells.columns:
        cells = cells.filter(F.col("regular_cycles") > min_regular_cycles)
    return cells


def scan_cells_interactive(cells: DataFrame, filters: dict | None = None,
                           min_total_cycles: int = MIN_TOTAL_CYCLES) -> DataFrame:
    """A4: keep ``total_cycles > min`` when present, and apply ``filters`` (the reference ignores them, Q1)."""
    if "total_cycles" in cells.columns:
        cells = cells.filter(F.col("total_cycles") > min_total_cycles)
    return filter_equals(cells, filters or {})


def clean_cycles(cycles: DataFrame) -> DataFrame:
    """``cell_id`` is required; rows with a NULL ``cell_id`` are dropped."""
    require_columns(cycles, [CELL])
    return cycles.dropna(subset=[CELL])


def chosen_cycles(cycles: DataFrame | ClusteredTable, ids: DataFrame | Sequence[int]) -> DataFrame:
    """C4: cycles of the chosen cells: a semi join over the table, or over the files of their bands where it is clustered."""
    return cycles.rows_of(ids) if isinstance(cycles, ClusteredTable) else semi_join_ids(clean_cycles(cycles), ids)


def cycles_for_cells(cycles: DataFrame | ClusteredTable, ids: DataFrame | Sequence[int],
                     cells: DataFrame | None = None) -> DataFrame:
    """Cycles of the chosen cells (one scan + semi join), with their metadata joined on."""
    chosen = chosen_cycles(cycles, ids)
    if cells is not None:
        chosen = join_metadata(chosen, semi_join_ids(cells, ids) if isinstance(ids, DataFrame) else cells)
    return chosen


def sorted_cycles(cycles: DataFrame) -> DataFrame:
    """cells in id order, cycles in ``regular_cycle_number`` (else ``cycle_number``) order.

    Operators never need this (order lives in their window specs); it is the final ``orderBy`` a caller asks
    for, a range-partitioned sort.
    """
    order = [CELL] + [c for c in ("regular_cycle_number", "cycle_number") if c in cycles.columns][:1]
    return cycles.orderBy(*order)


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """G1: stack frames by column name; columns missing from some frames become NULL (Q9)."""
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to stack")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> None:
    """Export. ``partition_by`` columns become folders; CSV gets a header row."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_query_result(df: DataFrame, path: str, rows_per_document: int = 10000) -> None:
    """The inverse of :func:`read_query_result` for JSON lines: documents of at most ``rows_per_document`` rows.

    Rows are numbered inside their input partition, so a document's rows come from one task and its size is bounded.
    """
    line = F.monotonically_increasing_id()
    parts = {"_partition": F.shiftright(line, 33), "_document": F.floor(line.bitwiseAND((1 << 33) - 1) / rows_per_document)}
    doc = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in parts.items()])
    doc = doc.groupBy(*parts).agg(F.collect_list("_row").alias("rows"))
    doc.select(F.struct(F.struct(F.col("rows").alias("rows")).alias("data")).alias("query_result")) \
        .write.mode("overwrite").json(path)
