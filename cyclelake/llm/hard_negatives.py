"""Operator 11, hard-negative mining by rotated one-bit codes with stored code-vector alignment.

A vector becomes integers, floor(scale * x). Its code holds the signs of the vector under ``TURNS`` fixed random rotations;
the signs rotated back are its code vector. Beside the code the vector's length, the code vector's length and the alignment
(cosine) of the two are stored. For an anchor q with product s with the unit code vector, the unit vector's product
with q is alignment * s + e, and by Cauchy-Schwarz |e| <= sqrt(1 - alignment^2) * sqrt(|q|^2 - s^2), as the residual is
orthogonal to the code vector. s is estimated by popcounts of the code with the bit planes of the quantised anchor; the
quantisation's error is known and widens the interval. So every interval holds its score for certain. (With one
rotation the alignment is about 0.8, with eight 0.97.)

1. Positives: anchors meet the rows of their label. Of an anchor's rows in a block, those whose upper end reaches
   the k-th largest lower end survive and get their integer scores.
2. Negatives: anchors, with the score windows of their positives, meet the rows of other labels. Rows survive whose
   interval touches a window and whose upper end reaches the k-th largest lower end of the rows certainly inside.

Anchors are a stated query set against all rows: both are cut into blocks by hash, and a task compares one block of anchors with
one of rows. Each block pair returns its first k rows per anchor (and positive), of which windows with partial limits
choose; every anchor is in few rows there. No index is fitted; results are exact, so recall is 1.

Defined results: rows with a null id, null label, null or empty vector, or a null or non-finite component take no part, nor do rows
whose integers are so large that scores could pass 64 bits (dimension * largest^2 >= 2^63); vectors of different
lengths are not compared. Rows of one id are different rows ("other rows" of each other); between equal scores and ids,
the stored order decides. Zero vectors score 0. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, stored
from .graph import whole_groups

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
ANCHORS, ROWS, PLANES, TURNS, SEED = 1024, 2048, 6, 8, 29
NONE = np.iinfo(np.int64).min


def rotation(size: int, turns: int = TURNS) -> np.ndarray:
    """Fixed random rotations side by side: ``size`` orthonormal rows of ``turns`` * ``size`` components."""
    rng = np.random.default_rng((SEED, size))
    each = []
    for _ in range(turns):
        q, r = np.linalg.qr(rng.standard_normal((size, size)))
        each.append(q * np.sign(np.diag(r)))
    return np.concatenate(each, axis=1) / np.sqrt(turns)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1, bitorder="little").view("<u8")


def encode(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes (64-bit words), lengths, alignments with the code vectors, and the code vectors' lengths."""
    bits = v @ turn > 0
    code = (np.where(bits, 1.0, -1.0) @ turn.T) / np.sqrt(turn.shape[1])
    span, length = (np.sqrt((x * x).sum(axis=1)) for x in (code, v))
    along = (v * code).sum(axis=1)
    whole = span * length
    return _packed(bits), length, np.divide(along, whole, out=np.zeros_like(whole), where=whole > 0), span


def intervals(codes: np.ndarray, length: np.ndarray, align: np.ndarray, span: np.ndarray, anchors: np.ndarray,
              turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the scores of all anchors (rows) with all vectors (columns)."""
    turned, size = anchors @ turn, turn.shape[1]
    low = turned.min(axis=1, keepdims=True)
    step = (turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1)
    level = np.rint(np.divide(turned - low, step, out=np.zeros_like(turned), where=step > 0))
    error = np.sqrt(((turned - low - level * step) ** 2).sum(axis=1, keepdims=True))
    digits, weighed = level.astype(np.uint8), np.zeros((len(anchors), len(codes)), np.int32)
    for p in range(PLANES):
        plane = _packed(digits >> p & 1)
        for w in range(codes.shape[1]):
            weighed += np.left_shift(np.bitwise_count(plane[:, w, None] & codes[None, :, w]), p, dtype=np.int32)
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.int64)
    inner = (low * (2 * ones - size) + step * (2 * weighed - level.sum(axis=1, keepdims=True))) / np.sqrt(size)
    span = np.where(span > 0, span, 1.0)
    s, error = inner / span, error / span
    own = np.sqrt((anchors * anchors).sum(axis=1, keepdims=True))
    least = np.maximum(np.abs(s) - error, 0)  # the true product is no smaller
    rest = np.sqrt(np.maximum(1 - align * align, 0))
    spread = (rest * np.sqrt(np.maximum(own * own - least * least, 0)) + align * error + 1e-9 * own) * length + 1e-6
    middle = align * s * length
    return middle - spread, middle + spread


def _kth(ends: np.ndarray, good: np.ndarray, k: int) -> np.ndarray:
    """Per anchor the k-th largest of its good lower ends, or minus infinity."""
    out = np.full((len(ends), 1), -np.inf)
    enough = np.flatnonzero(good.sum(axis=1) >= k)
    if len(enough):
        out[enough, 0] = np.partition(np.where(good[enough], ends[enough], -np.inf), ends.shape[1] - k, axis=1)[:, -k]
    return out


def _scores(a: np.ndarray, v: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Integer products of the pairs that are alive; the least integer for the others."""
    out = np.full(alive.shape, NONE)
    # products below 2^53 are exact in doubles
    exact = v.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(v).max(initial=0)) < 2.0 ** 53
    left, right = (a.astype(float), v.astype(float)) if exact else (a, v)
    for i in np.flatnonzero(alive.any(axis=1)).tolist():
        y = np.flatnonzero(alive[i])
        out[i, y] = right[y] @ left[i]
    return out


def _top(score: np.ndarray, good: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of each anchor whose scores reach its k-th largest good one (more than k when scores tie there)."""
    good = good & (score > NONE)
    held = np.where(good, score, NONE)
    if held.shape[1] > k:
        good &= held >= np.partition(held, held.shape[1] - k, axis=1)[:, -k, None]
    return np.nonzero(good)


def _first(group: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group by score descending, id and row."""
    order = np.lexsort((row, vec, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.diff(g, prepend=-1)) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[place < k]


def _base(scale: int):
    """Arrow function (vec, label, vector, anchor): rows that take part, with integers, code, length and alignment."""
    turns: dict[int, np.ndarray] = {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list[int]] = {}
            found: list[np.ndarray | None] = []
            for i, x in enumerate(batch.column(2)):
                x = x.values if x.is_valid else None
                v = None
                if x is not None and len(x) and not x.null_count:
                    with np.errstate(over="ignore"):
                        v = np.floor(float(scale) * x.to_numpy().astype(np.float64))
                    if not np.isfinite(v).all() or len(v) * float(np.abs(v).max()) ** 2 >= 2.0 ** 63:
                        v = None
                found.append(v)
                if v is not None:
                    by_size.setdefault(len(v), []).append(i)
            for size, places in by_size.items():
                turn = turns.setdefault(size, rotation(size)) if size not in turns else turns[size]
                v = np.stack([found[i] for i in places])
                code, length, align, span = encode(v, turn)
                at, whole = pa.array(places), v.astype("<i8")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at), pa.array([size] * len(places), pa.int32()),
                    pa.array([x.tobytes() for x in code], pa.binary()), pa.array(length), pa.array(align),
                    pa.array(span), pa.array([x.tobytes() for x in whole], pa.binary())],
                    ["vec", "label", "size", "code", "length", "align", "span", "vector"])

    return rows


class _Block:
    """Anchors and rows of one block pair."""

    def __init__(self, table: pa.Table, a: int, b: int, turns: dict[int, np.ndarray]):
        part = table.slice(a, b - a)
        anchor = part.column("is_anchor").to_numpy()
        self.anchors, self.rows = np.flatnonzero(anchor), np.flatnonzero(~anchor)
        size = part.column("size")[0].as_py()
        turn = turns.setdefault(size, rotation(size)) if size not in turns else turns[size]
        whole = np.frombuffer(b"".join(part.column("vector").to_pylist()), "<i8").reshape(b - a, size)
        codes = np.frombuffer(b"".join(part.column("code").to_pylist()), "<u8").reshape(b - a, -1)
        self.number, self.vec, label = (part.column(c).to_numpy() for c in ("row", "vec", "label"))
        numbers = [part.column(c).to_numpy()[self.rows] for c in ("length", "align", "span")]
        self.a, self.v = whole[self.anchors], whole[self.rows]
        self.low, self.high = intervals(codes[self.rows], *numbers, self.a.astype(float), turn)
        self.same = label[self.anchors][:, None] == label[self.rows][None, :]
        self.other = self.number[self.anchors][:, None] != self.number[self.rows][None, :]
        self.part = part


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    turns: dict[int, np.ndarray] = {}
    for table, starts in whole_groups(batches, "pair"):
        for a, b in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist()):
            if table.column("is_anchor")[a].as_py() != table.column("is_anchor")[b - 1].as_py():  # anchors come first
                yield _Block(table, a, b, turns)


_FOUND = ["anchor", "positive", "score", "vec", "row"]


def _rows_of(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], _FOUND)


def _positives(k: int):
    """Arrow function over block pairs: per anchor, the first ``k`` rows of its label (``positive`` is the anchor again)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            good = block.same & block.other
            value = _scores(block.a, block.v, good & (block.high >= _kth(block.low, good, k)))
            x, y = _top(value, good, k)
            score, where = value[x, y], block.rows[y]
            best = _first(x, score, block.vec[where], block.number[where], k)
            own = block.number[block.anchors[x[best]]]
            yield _rows_of([own, own, score[best], block.vec[where[best]], block.number[where[best]]])

    return rows


def _negatives(k: int, low: int, high: int):
    """Arrow function over block pairs whose anchors have ``found`` (row and score of their positives): per anchor and
    positive, the first ``k`` rows of other labels inside the window."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            own = [x or [] for x in block.part.column("found").take(pa.array(block.anchors)).to_pylist()]
            other, alive, windows, out = ~block.same, np.zeros(block.same.shape, bool), [], []
            for turn in range(max(map(len, own), default=0)):
                # integer ends of the window, ceil(low * p / 100) and floor(high * p / 100), in whole numbers; else empty
                ends = [(-(-low * x[turn]["score"] // 100), high * x[turn]["score"] // 100) if len(x) > turn else (1, 0) for x in own]
                least, most = (np.array(e, np.int64)[:, None] for e in zip(*ends))
                windows.append((turn, least, most))
                inside = other & (block.low >= least) & (block.high <= most)
                alive |= other & (least <= most) & (block.high >= np.maximum(least, _kth(block.low, inside, k))) & (block.low <= most)
            value = _scores(block.a, block.v, alive)
            for turn, least, most in windows:
                x, y = _top(value, (value >= least) & (value <= most), k)
                score, where = value[x, y], block.rows[y]
                best = _first(x, score, block.vec[where], block.number[where], k)
                out.append([block.number[block.anchors[x[best]]], np.array([own[i][turn]["row"] for i in x[best]], np.int64),
                            score[best], block.vec[where[best]], block.number[where[best]]])
            if out:
                yield _rows_of([np.concatenate(c) for c in zip(*out)])

    return rows


def _met(anchors: DataFrame, rows: DataFrame, bucket: list[str], more: list[str]) -> DataFrame:
    """Block pairs of anchors and rows of each bucket, sorted for the comparison, anchors first."""
    sizes = stored(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n_rows")).join(
        anchors.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n_anchors")), bucket), "negatives-buckets")
    blocks = sizes.select(*bucket, F.ceil(F.col("n_anchors") / ANCHORS).cast("int").alias("of_anchors"),
                          F.ceil(F.col("n_rows") / ROWS).cast("int").alias("of_rows"))

    def copies(df: DataFrame, own: str, other: str, is_anchor: bool) -> DataFrame:
        met = df.join(blocks, bucket).withColumns({
            "_own": F.pmod(F.xxhash64("row"), F.col(own)).cast("int"),
            "_other": F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        one, two = ("_own", "_other") if is_anchor else ("_other", "_own")
        kept = [F.col(c) if c in df.columns else F.lit(None).cast("array<struct<row:long,score:long>>").alias(c) for c in more]
        return met.select(F.xxhash64(*bucket, one, two).alias("pair"), F.lit(is_anchor).alias("is_anchor"), "row", "vec",
                          F.xxhash64("label").alias("label"), "size", "code", "length", "align", "span", "vector", *kept)

    both = copies(anchors, "of_anchors", "of_rows", True).union(copies(rows, "of_rows", "of_anchors", False))
    return both.repartition("pair").sortWithinPartitions("pair", F.col("is_anchor").desc())


def _place(*keys: str) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), "vec", "row"))


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label: str | Column = "label", scale: int = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    An anchor's positives are its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels
    with ``low`` to ``high`` percent of the positive's score.
    """
    ship(df.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    usable = df.where(F.col(id_col).isNotNull() & label.isNotNull()).select(
        F.struct(F.col(id_col).cast("long").alias("id"), F.coalesce(anchor, F.lit(False)).alias("asks")).alias("vec"),
        label.cast("string").alias("label"), F.col(vector_col).alias("vector"))
    base = usable.mapInArrow(_base(scale), "vec struct<id:long,asks:boolean>, label string, size int, code binary, "
                                              "length double, align double, span double, vector binary")
    base = stored(base.select(F.monotonically_increasing_id().alias("row"), F.col("vec.id").alias("vec"),
                              F.col("vec.asks").alias("asks"), "label", "size", "code", "length", "align", "span", "vector"), "negatives-base")
    asking, rows = base.where("asks"), base
    result = "anchor long, positive long, score long, vec long, row long"
    near = _met(asking, rows, ["size", "label"], []).mapInArrow(_positives(positives), result)
    near = stored(near.withColumn("place", _place("anchor")).where(F.col("place") <= positives)
                  .select("anchor", "row", "score", F.col("vec").alias("positive_id")), "negatives-positives")
    found = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("row", "score")).alias("found"))
    met = _met(asking.join(found, "row"), rows, ["size"], ["found"]).mapInArrow(_negatives(negatives, low, high), result)
    best = met.withColumn("rank", _place("anchor", "positive")).where(F.col("rank") <= negatives)
    pairs = near.select("anchor", F.col("row").alias("positive"), "positive_id", F.col("score").alias("positive_score"))
    names = asking.select(F.col("row").alias("anchor"), F.col("vec").alias("anchor_id"))
    return best.join(pairs, ["anchor", "positive"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
