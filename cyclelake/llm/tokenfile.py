"""Operator 9, token-ID output in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents: a header, the index of block starts, and blocks of ``BLOCK`` ids.
A block stores its minimum and packs the differences at the width that ``percentile`` of them need; the rest go to
an exception list (position, high bits). One seek to ``starts[i // BLOCK]`` reaches any id.

    segment := "PFR1" | ids u32 | blocks u32 | starts u32[blocks] | block...
    block   := minimum u32 | width u8 | pad u8 | exceptions u16 | position u16[] | high u32[] | packed bits

Segments are rows of a Parquet table in ascending order of the id column (part, segment), so Spark writes, commits and
reads the files, and a lost task's file is written anew. Documents are range-partitioned by id before encoding; ids
before each file come from one sum per file.

Defined results: a null or empty text has the end id alone; equal ids stand side by side, ordered by text; a null id
comes first; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, text_slices, tidy
from .encode import encoder

BLOCK = 1024
MAGIC = b"PFR1"
_STEP = 512  # blocks packed at a time


def _pack_bits(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of packed bytes, most significant bit first."""
    bits = np.unpackbits(low.astype(">u4").view(np.uint8).reshape(len(low), BLOCK, 4), axis=2)
    return np.packbits(bits[:, :, 32 - width:].reshape(len(low), BLOCK * width), axis=1)


def _unpack_bits(rows: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
    bits[:, :, 32 - width:] = np.unpackbits(rows, axis=1).reshape(len(rows), BLOCK, width)
    return np.packbits(bits.reshape(len(rows), BLOCK * 32), axis=1).view(">u4").astype(np.uint32)


def encode_segment(ids: np.ndarray, percentile: float = 0.95) -> bytes:
    """The bytes of one segment of unsigned 32-bit ids."""
    count = -(-len(ids) // BLOCK)
    blocks: list[bytes] = []
    for at in range(0, count, _STEP):
        part = ids[at * BLOCK:(at + _STEP) * BLOCK]
        rows = np.concatenate([part, np.full(-len(part) % BLOCK, part.min() if len(part) else 0, np.uint32)])
        rows = rows.reshape(-1, BLOCK)
        least = rows.min(axis=1)
        rest = rows - least[:, None]
        need = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # bits of each difference
        widths = np.sort(need, axis=1)[:, min(BLOCK - 1, int(percentile * BLOCK))]
        out: list[bytes] = [b""] * len(rows)
        for width in np.unique(widths):
            which, width = np.flatnonzero(widths == width), int(width)
            packed = _pack_bits(rest[which] & np.uint32((1 << width) - 1), width) if width else None
            for k, i in enumerate(which):
                odd = np.flatnonzero(need[i] > width)
                out[i] = b"".join([struct.pack("<IBxH", least[i], width, len(odd)), odd.astype("<u2").tobytes(),
                                   (rest[i][odd] >> np.uint32(width)).astype("<u4").tobytes(),
                                   packed[k].tobytes() if width else b""])
        blocks += out
    head = 12 + 4 * count
    starts = head + np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.zeros(0)
    return b"".join([MAGIC, struct.pack("<II", len(ids), count), starts.astype("<u4").tobytes(), *blocks])


def decode_segment(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a segment, or those of the blocks ``first`` to ``last`` - 1 only."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    total, count = struct.unpack_from("<II", data, 4)
    starts = np.frombuffer(data, "<u4", count, 12)
    last = count if last is None else last
    out = np.zeros((last - first, BLOCK), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    heads, widths = [], np.zeros(last - first, np.int64)
    for i in range(first, last):
        least, width, odd = struct.unpack_from("<IBxH", data, starts[i])
        heads.append((int(starts[i]) + 8, least, odd))
        widths[i - first] = width
    for width in np.unique(widths):
        if width:
            which = np.flatnonzero(widths == width)
            for some in np.split(which, range(_STEP, len(which), _STEP)):
                at = np.array([heads[i][0] + 6 * heads[i][2] for i in some])
                out[some] = _unpack_bits(raw[at[:, None] + np.arange(BLOCK * width // 8)], int(width))
    for i, (at, least, odd) in enumerate(heads):
        if odd:
            place = np.frombuffer(data, "<u2", odd, at)
            out[i, place] |= np.frombuffer(data, "<u4", odd, at + 2 * odd) << np.uint32(widths[i])
        out[i] += np.uint32(least)
    return out.reshape(-1)[:total - first * BLOCK]


def write(df: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, id_col: str = "doc_id",
          text_col: str = "text", segment_ids: int = 1 << 20, percentile: float = 0.95) -> None:
    """Encode every document of ``df``, append ``end_id``, and write segments in ascending ``id_col`` order.

    A segment ends with the document that brings it to ``segment_ids`` ids.
    """
    ship(df.sparkSession)
    kept = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # rows of one id (or of none) are dealt by how their texts begin, which keeps the order
    ordered = kept.repartitionByRange("_id", F.substring("_text", 1, 16)).sortWithinPartitions("_id", "_text")
    kind_of_id = df.schema[id_col].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part = encoder(tokenizer, kind), TaskContext.get().partitionId()
        end, held, docs, sizes = np.array([end_id], np.uint32), [], [], []
        number, before, size, type_of = 0, 0, 0, None

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held)
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()),
                       pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(type_of)),
                       pa.array([sizes], pa.list_(pa.int64())), pa.array([encode_segment(ids, percentile)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "segment", "before", "ids", "docs", "sizes", "data"])

        for rows in text_slices(batches):
            type_of = rows.schema.field(0).type
            for doc, ids in zip(rows.column(0).to_pylist(), library.encode(rows.column(1))):
                held += [ids, end]
                docs.append(doc)
                sizes.append(len(ids) + 1)
                size += sizes[-1]
                if size >= segment_ids:
                    yield out()
                    number, before, size, held, docs, sizes = number + 1, before + size, 0, [], [], []
            held = [np.concatenate(held)] if held else []  # let go of the slice's arrays
        if docs:
            yield out()

    schema = (f"part int, segment int, before long, ids long, docs array<{kind_of_id}>, sizes array<long>, data binary")
    ordered.mapInArrow(tidy(segments), schema).write.option("compression", "zstd").parquet(path)


def located_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of the files at ``path`` with the number of ids before each.

    The sums per file are one row for each file, attached by broadcast: their number is that of the write's tasks.
    """
    table = spark.read.parquet(path)
    files = table.groupBy("part").agg(F.sum("ids").alias("_ids"))
    ahead = F.coalesce(F.sum("_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    located = table.join(F.broadcast(files.select("part", ahead.alias("_ahead"))), "part")
    return located.select("docs", "sizes", (F.col("_ahead") + F.col("before")).alias("first"), "data")


def documents(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document: ``id_col``, start, n_tokens, ids_crc32 and, on request, the ids themselves."""
    ship(spark)
    located = located_segments(spark, path)
    kind_of_id = located.schema["docs"].dataType.elementType.simpleString()
    schema = f"`{id_col}` {kind_of_id}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, sizes = batch.column(0)[i].values, batch.column(1)[i].values.to_numpy()
                ids = decode_segment(batch.column(3)[i].as_py())
                ends = np.cumsum(sizes)
                each = np.split(ids, ends[:-1])
                columns = [docs, pa.array(batch.column(2)[i].as_py() + ends - sizes, pa.int64()),
                           pa.array(sizes, pa.int64()),
                           pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in each], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                                            pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0].strip("`") for c in schema.split(", ")])

    return located.mapInArrow(tidy(rows), schema)
