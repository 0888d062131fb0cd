"""Operator 1, hierarchical multi-length packing.

Token sequences are routed to context tiers (powers of two up to ``context``): whole windows of ``context`` ids are
cut off a document, the rest goes to the smallest tier that holds it. Tiers are packed from the longest down: each
window opens with the longest waiting rest, and its gap is filled from the shorter ones, first with whole rests
(best fit), last with a cut one, so windows end full. Windows are then dealt to step groups of equal tokens, and
among those by attention cost.

Each input partition is packed by itself as a stream: no shuffle, no data gathered, and memory bounded by a slice of
texts. What a partition holds over at its end is cut into windows of falling powers of two, so that nothing is
padded. A lost executor's partitions are packed again to the same rows, as file scans are deterministic.

Defined results: a null or empty text is the end id alone; ids and texts may repeat (each row is a document of its
own); columns besides id and text are not read; an empty table packs to no rows.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_slices, tidy
from .encode import encoder

PIECE = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, "
         "step_group long")
_SIZE = itemgetter(0)


class Packer:
    """Packs the documents of one stream. An item is (ids left, serial, document, its tokens, start, ids)."""

    def __init__(self, context: int, step_tokens: int, first_id: int):
        if context & (context - 1):
            raise ValueError("context must be a power of two")
        self.context, self.step_tokens, self.next_id, self.first_id = context, step_tokens, first_id, first_id
        self.serial = 0
        self.open: list[tuple] = []  # pieces of the window that is being filled
        self.room = 0
        self.windows: list[tuple[int, list[tuple]]] = []  # closed ones: context, pieces
        self.groups = first_id

    def _item(self, doc, total, start, ids):
        self.serial += 1
        return (len(ids), self.serial, doc, total, start, ids)

    def _close(self) -> None:
        self.windows.append((sum(x[0] for x in self.open), self.open))
        self.open, self.room = [], 0

    def _put(self, item: tuple, pool: list[tuple]) -> None:
        """Place an item in the open window; what doesn't fit goes back to the pool."""
        n, _, doc, total, start, ids = item
        if n > self.room:
            insort(pool, self._item(doc, total, start + self.room, ids[self.room:]), key=_SIZE)
            n, ids = self.room, ids[:self.room]
        self.open.append((n, 0, doc, total, start, ids))
        self.room -= n
        if self.room == 0:
            self._close()

    def add(self, docs: list, sequences: list[np.ndarray]) -> None:
        pool: list[tuple] = []
        for doc, ids in zip(docs, sequences):
            total, whole = len(ids), len(ids) // self.context * self.context
            for at in range(0, whole, self.context):
                self.windows.append((self.context, [(self.context, 0, doc, total, at, ids[at:at + self.context])]))
            if total > whole:
                pool.append(self._item(doc, total, whole, ids[whole:]))
        pool.sort(key=_SIZE)
        while pool:
            if not self.open:
                item = pool.pop()
                self.room = 1 << (item[0] - 1).bit_length()  # the tier that holds it
                self._put(item, pool)
            else:  # the longest that fits whole, else the shortest, cut
                self._put(pool.pop(max(0, bisect_right(pool, self.room, key=_SIZE) - 1)), pool)
        # the open window's ids are kept, not the slice they came from
        self.open = [(*x[:5], x[5].copy()) for x in self.open]

    def finish(self) -> None:
        """Cut what the open window holds into windows of falling powers of two."""
        pool, left = self.open[::-1], sum(x[0] for x in self.open)
        self.open = []
        while left:
            self.room = 1 << (left.bit_length() - 1)
            left -= self.room
            while self.room:
                item = pool.pop()
                if item[0] > self.room:
                    pool.append((item[0] - self.room, 0, *item[2:4], item[4] + self.room, item[5][self.room:]))
                    item = (self.room, 0, *item[2:5], item[5][:self.room])
                self._put(item, pool)

    def rows(self) -> Iterator[tuple]:
        """The closed windows' pieces, with step groups balanced by tokens, then by attention cost."""
        cost = lambda w: sum(x[0] ** 2 for x in w[1])
        groups = max(1, round(sum(w[0] for w in self.windows) / self.step_tokens))
        loads = [(0, 0, self.groups + g) for g in range(groups)]
        for size, pieces in sorted(self.windows, key=lambda w: (-w[0], -cost(w))):
            tokens, work, group = loads[0]
            heapq.heapreplace(loads, (tokens + size, work + cost((size, pieces)), group))
            offset = 0
            for n, _, doc, total, start, ids in pieces:
                crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
                yield doc, start, n, crc, total, self.next_id, offset, 1 << (size - 1).bit_length(), group
                offset += n
            self.next_id += 1
        self.groups += groups
        self.windows = []


def pack(df: DataFrame, tokenizer: str, kind: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         context: int = 4096, step_tokens: int = 65536) -> DataFrame:
    """Pieces of all documents of ``df``: the id column and ``PIECE``'s columns.

    ``tokenizer``: vocabulary file, at the same path on every executor; ``kind``: see :mod:`.encode`.
    ``sequence_id`` and ``step_group`` are unique over the table (partition number and a running number).
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {PIECE}"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer, kind)
        packer = Packer(context, step_tokens, TaskContext.get().partitionId() << 40)
        names = [id_col, *(c.split()[0] for c in PIECE.split(", "))]
        types = None

        def out() -> Iterator[pa.RecordBatch]:
            if got := list(packer.rows()):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), types)], names)

        for part in text_slices(batches):
            types = [part.schema.field(0).type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            end = np.array([end_id], np.uint32)
            packer.add(part.column(0).to_pylist(), [np.concatenate([x, end]) for x in library.encode(part.column(1))])
            yield from out()
        packer.finish()
        yield from out()

    return rows.mapInArrow(tidy(packed), schema)
