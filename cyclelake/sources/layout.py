"""Clustered copies of a table (A5, A6, A7, C4): few, bounded files, and lookups that read only the files of their keys.

:func:`write_sorted` range-partitions rows by the folder columns, an order and a hash of the whole row, so that a hot
folder or key is spread over tasks, and writes each task's stretch of that order. A folder then has the files of the tasks that
touch it, not one of every task: at most ``tasks + folders - 1 + rows / rows_per_file`` files in all.

:func:`write_clustered` uses one folder per *band* of a key's hash. :class:`ClusteredTable` reads the rows of a set of keys from
their bands' folders only (partition filters); inside a band files are sorted by key, so the least and largest wanted key rule
out files and row groups by their statistics. Rows without a key have a band of their own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import matched

BANDS = 256
ROWS_PER_FILE = 4_000_000
_BAND = re.compile(r"_band_of_(\d+)$")


def write_sorted(df: DataFrame, path: str, partition_by: Sequence[str] = (), order: Sequence[str] = (),
                 rows_per_file: int = ROWS_PER_FILE, tasks: int | None = None, fmt: str = "parquet",
                 mode: str = "errorifexists") -> None:
    """Write ``df`` in folders of ``partition_by``, rows in ``order`` over the files of a folder.

    ``tasks``: range partitions; by default the session's shuffle partitions, which AQE may merge.
    """
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    sort = [*[F.col(f"`{c}`") for c in (*partition_by, *order)], F.xxhash64(*hashed)]
    ranged = df.repartitionByRange(tasks, *sort) if tasks else df.repartitionByRange(*sort)
    writer = ranged.sortWithinPartitions(*sort).write.mode(mode).format(fmt).option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def _band(key: Column, bands: int) -> Column:
    return F.when(key.isNull(), F.lit(bands)).otherwise(F.pmod(F.xxhash64(key), F.lit(bands)).cast("int"))


def write_clustered(df: DataFrame, path: str, key: str, order: Sequence[str] = (), bands: int = BANDS,
                    rows_per_file: int = ROWS_PER_FILE, tasks: int | None = None, mode: str = "errorifexists") -> None:
    """Write ``df`` clustered by ``key``; ``mode="append"`` adds rows under the same number of bands."""
    write_sorted(df.withColumn(f"_band_of_{bands}", _band(F.col(key), bands)), path, [f"_band_of_{bands}"], [key, *order],
                 rows_per_file, tasks, mode=mode)


@dataclass(frozen=True)
class ClusteredTable:
    """A table that :func:`write_clustered` wrote. ``stored`` has the band column, whose name holds the number of bands."""

    stored: DataFrame
    key: str

    @staticmethod
    def read(spark: SparkSession, path: str, key: str) -> ClusteredTable:
        return ClusteredTable(spark.read.parquet(path), key)

    @property
    def band(self) -> str:
        found = [c for c in self.stored.columns if _BAND.match(c)]
        if len(found) != 1:
            raise ValueError("not one clustered table: its folders need one number of bands")
        return found[0]

    def rows(self) -> DataFrame:
        """The whole table."""
        return self.stored.drop(self.band)

    def rows_of(self, ids: DataFrame | Sequence) -> DataFrame:
        """The rows whose key is in ``ids`` (NULL matches nothing).

        A list becomes constant filters. For a DataFrame (its first column) one job finds the bands, of which there are few
        whatever its size, and the least and largest key; then a semi join, without an aggregate of the ids, keeps the rows.
        """
        band, kind = self.band, self.stored.schema[self.key].dataType
        bands = int(_BAND.match(band).group(1))
        if not isinstance(ids, DataFrame):
            wanted = [F.lit(i).cast(kind) for i in ids if i is not None]
            if not wanted:
                return self.rows().where(F.lit(False))
            chosen = F.col(band).isin(*[_band(i, bands) for i in wanted])
            return self.stored.where(chosen & F.col(self.key).isin(*wanted)).drop(band)
        keys = ids.select(F.col(ids.columns[0]).cast(kind).alias(self.key)).where(F.col(self.key).isNotNull())
        seen = keys.agg(F.collect_set(_band(F.col(self.key), bands)).alias("bands"), F.min(self.key).alias("least"),
                        F.max(self.key).alias("most")).first()
        if not seen["bands"]:
            return self.rows().where(F.lit(False))
        near = F.col(band).isin(sorted(seen["bands"])) & F.col(self.key).between(F.lit(seen["least"]), F.lit(seen["most"]))
        return matched(self.stored.where(near).drop(band), keys, self.key, "left_semi")
