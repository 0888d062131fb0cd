"""Operator 13, line dedup: two Bloom filters find the lines that may repeat, and only those are compared exactly.

1. Each slice of texts hashes its long lines' keys. A hash held by several rows of the slice is known to repeat; the
   others go to their *segment*, a stretch of the hash space, as packed 64-bit numbers (hash, row), and of those known
   to repeat only the hash goes there, once a slice. So a line that every document holds costs a segment one number a
   slice, and no text moves.
2. A segment has two Bloom filters of fixed size: hashes seen once, and hashes that the first had when they came
   again. Their number grows with the text's bytes, so that a filter is never overfull, and none is broadcast. The hashes that the
   second filter holds are suspected, about 0.5 % of the lines that don't repeat among them.
3. Texts meet the suspected hashes of their row, and the suspected lines alone are shuffled by their whole key: documents are
   counted exactly and the largest id is chosen, partially aggregated. A frequent key's lines go, but for that id.

A text is cut at line feeds; a null or empty text is one empty line (and stays as it is). A line's key is the line
without ASCII white space at its ends, A-Z lower-cased. Documents are told apart by their id: rows of one id are one
document, and all rows of the largest id keep their lines. A row without an id is not counted and keeps its lines. A
repeat inside one document is no repeat, but where a key goes, all its lines in the document go. Ties don't occur.
Texts of any length are read whole. An empty table gives an empty table; other columns are returned unchanged (columns
named as the two counts are replaced).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ship, stored, text_slices
from .graph import whole_groups

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Keys a segment is made for, bits of each of its filters, and bits a key sets: three pieces of 21 of its hash.
SEGMENT_KEYS, FILTER_BITS, PROBES = 1 << 17, 1 << 21, 3

_ONCE, _TWICE, _KNOWN = 0, 1, 2


def line_keys(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The lines of all texts, each text's first line's place (and the end), and the lines' keys."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    lines, offsets = lists.flatten(), lists.offsets.to_numpy()
    return lines, offsets - offsets[0], pc.ascii_lower(pc.utf8_trim(lines, characters=SPACES))


def long_keys(texts: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Distinct pairs (text, key) of keys of enough code points: text and key numbers, the keys, and their hashes."""
    _, starts, keys = line_keys(texts)
    coded = keys.dictionary_encode()
    enough = pc.greater_equal(pc.utf8_length(coded.dictionary), least_chars).to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    used = enough[code]
    pairs = np.unique(owner[used] * max(1, len(enough)) + code[used])
    owner, code = pairs // max(1, len(enough)), pairs % max(1, len(enough))
    number = np.cumsum(enough) - 1
    spelt = coded.dictionary.filter(pa.array(enough)).to_pylist()
    hashes = np.frombuffer(b"".join(hashlib.blake2b(k.encode(), digest_size=8).digest() for k in spelt), "<u8")
    return owner, number[code], spelt, hashes


def probes(hashes: np.ndarray) -> np.ndarray:
    """The filter bits of each hash."""
    return np.stack([(hashes >> np.uint64(21 * i)) & np.uint64(FILTER_BITS - 1) for i in range(PROBES)], axis=1).astype(np.int64)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The stretch of the hash space, by a second mixing of the hash, so that the filter bits stay even."""
    mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def suspected(deltas: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """Per delta (kind, distinct hashes) of one segment, which of its hashes the twice-seen filter holds at last."""
    once, twice = np.zeros(FILTER_BITS, bool), np.zeros(FILTER_BITS, bool)
    for kind, hashes in deltas:
        bits = probes(hashes)
        twice[bits if kind == _TWICE else bits[once[bits].all(axis=1)]] = True
        once[bits] = True
    return [twice[probes(hashes)].all(axis=1) for _, hashes in deltas]


def _hashed(least_chars: int, segments: int):
    """Arrow function (row, text): packed hashes (and their rows) by kind and segment."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            owner, code, _, hashes = long_keys(part.column(1), least_chars)
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.unique(np.stack([ids[owner], code]), axis=1)  # equal rows of a slice count once
            row, code = own[0], own[1]
            repeats = np.bincount(code, minlength=len(hashes)) > 1
            known, value = repeats[code], hashes[code]
            segment = segment_of(hashes, segments)
            out = [(_KNOWN, -1, value[known].tobytes(), row[known].tobytes())] if known.any() else []
            for kind, where, held in ((_ONCE, segment[code][~known], (value[~known], row[~known])),
                                      (_TWICE, segment[repeats], (hashes[repeats],))):
                order = np.argsort(where, kind="stable")
                places = np.flatnonzero(np.diff(where[order], prepend=-1)) if len(order) else []
                for x in np.split(order, places[1:]) if len(order) else []:
                    packed = [h[x].tobytes() for h in held]
                    out.append((kind, int(where[x[0]]), packed[0], packed[1] if len(packed) > 1 else b""))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["kind", "segment", "hashes", "rows"])

    return rows


def _pairs(hashes: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, hashes)]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["row", "hash"])


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, hash) that the filters of their segment suspect."""
    for table, starts in whole_groups(batches, "segment"):
        kinds, packed, rows = (table.column(c).to_pylist() for c in ("kind", "hashes", "rows"))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(kinds)).tolist()):
            deltas = [(kinds[i], np.frombuffer(packed[i], "<u8")) for i in range(a, b)]
            found = suspected(deltas)
            keep = [(h[f], np.frombuffer(rows[a + i], "<i8")[f]) for i, ((kind, h), f) in enumerate(zip(deltas, found))
                    if kind == _ONCE]
            yield _pairs([h for h, _ in keep], [r for _, r in keep])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _pairs([np.frombuffer(x, "<u8") for x in batch.column(0).to_pylist()],
                     [np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()])


def _spelt(least_chars: int):
    """Arrow function (row, text, id, suspected hashes): rows (row, id, key) of the suspected lines."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            owner, code, spelt, hashes = long_keys(part.column(1), least_chars)
            lists = part.column(3)
            asked = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            near, number = np.unique(np.concatenate([hashes, lists.flatten().to_numpy().view(np.uint64)]), return_inverse=True)
            wanted = np.unique(asked * len(near) + number[len(hashes):])
            good = np.isin(owner * len(near) + number[:len(hashes)][code], wanted)
            at = pa.array(owner[good])
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), pa.array(
                spelt, pa.string()).take(pa.array(code[good]))], ["row", "id", "key"])

    return rows


def _without(texts: pa.Array, drops: pa.Array) -> pa.Array:
    """Each text without the lines whose keys are listed, and how many those are; null where there is no list."""
    out = []
    for i in range(len(texts)):
        if drops[i].is_valid:
            lines, _, keys = line_keys(texts[i:i + 1])
            stays = pc.invert(pc.is_in(keys, value_set=drops[i].values))
            out.append(("\n".join(lines.filter(stays).to_pylist()), len(lines) - stays.true_count))
        else:
            out.append(None)
    return pa.array([x and dict(zip(("text", "dropped"), x)) for x in out], pa.struct({"text": pa.string(), "dropped": pa.int64()}))


def _row_key(id_col: str, text_col: str) -> Column:
    """A number of the row: equal for equal (id, text). Rows of one id that share it by chance share a list of
    lines to drop, which holds for the id anyhow."""
    return F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col, text_col))


def frequent_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
                   least_docs: int = LEAST_DOCS, segments: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, id, key) of all suspected lines, and (key, documents, keeper) of those in enough documents."""
    if least_docs < 2:
        raise ValueError("least_docs must be at least 2")
    ship(df.sparkSession)
    texts = df.select(_row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"),
                      F.col(id_col).alias("id")).where("id IS NOT NULL AND text IS NOT NULL")
    if segments is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        segments = 1 + size // (least_chars * SEGMENT_KEYS)
    hashed = stored(texts.select("row", "text").mapInArrow(
        _hashed(least_chars, segments), "kind int, segment long, hashes binary, rows binary"), "line-hashes")
    routed = hashed.where(F.col("kind") != _KNOWN).repartition("segment").sortWithinPartitions("segment")
    known = hashed.where(F.col("kind") == _KNOWN).select("hashes", "rows").mapInArrow(_unpacked, "row long, hash long")
    doubted = stored(routed.mapInArrow(_filtered, "row long, hash long").union(known), "line-suspects")
    lists = doubted.groupBy("row").agg(F.collect_set("hash").alias("hashes"))
    lines = stored(texts.join(lists, "row").select("row", "text", "id", "hashes").mapInArrow(
        _spelt(least_chars), f"row long, id {dict(df.dtypes)[id_col]}, key string"), "line-suspected")
    counts = lines.select("key", "id").distinct().groupBy("key").agg(
        F.count(F.lit(1)).alias("documents"), F.max("id").alias("keeper"))
    return lines, stored(counts.where(F.col("documents") >= least_docs), "line-frequent")


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
               least_docs: int = LEAST_DOCS, segments: int | None = None, lines_col: str = "n_lines",
               dropped_col: str = "n_dropped") -> DataFrame:
    """``df`` with the frequent lines gone from ``text_col``, and the numbers of lines before and of those dropped."""
    lines, frequent = frequent_lines(df, id_col, text_col, least_chars, least_docs, segments)
    gone = lines.join(frequent, "key").where("id <> keeper")
    lists = gone.groupBy(F.col("id").alias("_gone_id"), F.col("row").alias("_gone_row")).agg(F.collect_set("key").alias("_keys"))
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_own_id"), _row_key(id_col, text_col).alias("_own_row"))
    met = rows.join(lists, [rows["_own_id"] == lists["_gone_id"], rows["_own_row"] == lists["_gone_row"]], "left")
    text = F.col(f"_row.{text_col}")
    without = F.arrow_udf(_without, "text string, dropped long")
    cut = without(F.when(F.col("_keys").isNotNull(), text.cast("string")), F.col("_keys"))
    done = met.select("_row", cut.alias("_cut"))
    n_lines = F.length(text) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(""))) + 1
    own = [F.coalesce("_cut.text", text).alias(c) if c == text_col else F.col("_row").getField(c).alias(c)
           for c in df.columns if c not in (lines_col, dropped_col)]
    return done.select(*own, F.coalesce(n_lines, F.lit(1)).cast("long").alias(lines_col),
                       F.coalesce("_cut.dropped", F.lit(0)).cast("long").alias(dropped_col))
