"""Shared pieces: written tables that cut lineage, the word pattern, and slicing of Arrow batches by bytes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Fixed value: characters that separate words (space, tab, LF, VT, FF, CR).
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 16 << 20


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one written table, in the shared folder the session names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there, and an executor lost
    later costs a re-read, not a recomputation."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once per application), so that they need no PYTHONPATH."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "cyclelake.zip")  # served to the executors by the driver
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)


def words(text: Column) -> Column:
    """Array of the words of ``text``; a null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " ", -1),
                    lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, as long; 0 for a null text."""
    return F.size(words(text)).cast("long")


def text_slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one slice hold about ``limit`` bytes (one longer text stands alone)."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``rows`` for mapInArrow that gives its worker's free memory back when a partition ends: workers are used again
    by later stages, beside the JVM's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's own free lists
            if trim:
                trim(0)

    return run
