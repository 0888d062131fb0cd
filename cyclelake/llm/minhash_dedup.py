"""Operator 5, MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes), a digest of that set and a MinHash
   signature of ``HASHES`` values. Texts of equal sets form a class, compared once through its least id.
2. Signatures are cut into ``BANDS`` bands; classes that share a band's bucket are candidates (a pair at similarity
   0.75 shares none with probability 1e-5).
3. Candidates are verified sequentially: after each batch of signature values the posterior of the similarity, given
   the matches so far and a uniform prior, is Beta(matches + 1, misses + 1); a pair is pruned as soon as the chance of
   reaching the limit falls below ``MISS``. Survivors are confirmed on their full sets.
4. Links join classes to components. Each class is first tried with the bucket mate it shares most bands with, then
   each component with one that it often meets; last, every remaining candidate pair of different components is
   compared, in blocks of bounded size that return spanning links only. Pairs inside one component need no comparison, so a large group of near
   copies costs about its size, not its square, and no candidate that could still join two components is left out.

Defined results: A-Z are lower-cased, words are runs of other than ASCII white space; fewer than five words form one
shingle; a text without words (or null) has no shingles and links with nothing; rows of equal ids are one node; a null
id links with nothing and has no component (it is kept); other columns are not read; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, stored, text_slices, tidy
from .graph import components, pair_blocks, whole_groups

WORDS, LIMIT = 5, 0.75
BANDS, ROWS, BATCH, MISS = 30, 4, 20, 1e-5
HASHES = BANDS * ROWS
BLOCK, ROUNDS, PAIRS, SEED = 512, 1, 100_000, 23

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_draw = np.random.default_rng(SEED)
_WORD = _draw.integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_A = _draw.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_BAND = _draw.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer for 64-bit sums."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if len(texts) == 0:
        return []
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    folded = pa.Array.from_buffers(pa.string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(_FOLD[data])],
                                   offset=texts.offset)
    lists = pc.split_pattern(folded, " ")
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    spelt = coded.dictionary.to_pylist()
    each = np.frombuffer(b"".join([hashlib.blake2b(w.encode(), digest_size=8).digest() for w in spelt]), "<u8")
    index = coded.indices.to_numpy(zero_copy_only=False)
    present = np.array([w != "" for w in spelt], bool)[index] if len(spelt) else np.zeros(0, bool)
    word = each[index][present]
    ends = np.append(0, np.cumsum(present))[starts]
    sums = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        sums += word[k:k + len(sums)] * _WORD[k]
    sums = _mix(sums)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(sums[a:b - WORDS + 1]))
        elif b > a:
            out.append(_mix((word[a:b] * _WORD[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(items: np.ndarray) -> np.ndarray:
    """MinHash values (upper 32 bits of multiply-add hashes) of a nonempty set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(items), 1024):
        least = np.minimum(least, (items[at:at + 1024, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def fewest_matches(limit: float = LIMIT, miss: float = MISS) -> list[int]:
    """After each batch, the least number of matches that is not pruned.

    P(similarity >= limit | m of n match) is the Beta(m + 1, n - m + 1) tail, a binomial sum.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * limit ** m * (1 - limit) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


_FEWEST = fewest_matches()


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of the signature pairs (rows of ``a`` and ``b``) that no batch prunes."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, fewest in enumerate(_FEWEST):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        good = matches >= fewest
        alive, matches = alive[good], matches[good]
    return alive


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def _linked(x: bytes, y: bytes) -> bool:
    """Whether two whole sets reach the limit."""
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        sets = shingles(part.column(1))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        signs = [signature(s).tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([
            part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
            pa.array(signs, pa.binary())], ["node", "n_shingles", "digest", "signs"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = _matrix(batch.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = _mix((rows * _BAND).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            node = np.repeat(batch.column(0).to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys.reshape(-1).view(np.int64)), pa.array(band)],
                                             ["node", "key", "band"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.astype("<u8").tobytes() for s in shingles(part.column(1))],
                                                                   pa.binary())], ["node", "items"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, signature of a, signature of b): the pairs that survive."""
    for batch in batches:
        alive = survivors(_matrix(batch.column(2)), _matrix(batch.column(3))) if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive, pa.int64())) for i in (0, 1)], ["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, set of a, set of b): the pairs at or above the limit."""
    for batch in batches:
        keep = pa.array([_linked(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _likely_pairs(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of different components that survive, from block pairs; each pair in the first band it shares."""
    node, group, band = (table.column(c).to_numpy() for c in ("node", "component", "band"))
    side, same, main = (table.column(c).to_numpy() for c in ("_side", "_same", "main"))
    signs = _matrix(table.column("signs"))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def tested() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if held:
            x, y = (np.concatenate(v) for v in zip(*held))
            alive = survivors(signs[x], signs[y])
            x, y = x[alive], y[alive]
            shared = (signs[x] == signs[y]).reshape(-1, BANDS, ROWS).all(axis=2)
            first = shared.argmax(axis=1) == band[x]
            x, y, likeness = x[first], y[first], (signs[x[first]] == signs[y[first]]).sum(axis=1)
            order = np.argsort(-likeness, kind="stable")
            yield x[order], y[order]
        held.clear()

    for a, b in zip(starts.tolist(), np.append(starts[1:], len(node)).tolist()):
        x, y = (np.array([a]), np.array([a + 1])) if b - a == 2 else (v + a for v in np.triu_indices(b - a, 1))
        good = (group[x] != group[y]) & ~(main[x] & main[y]) & (same[x] & same[y] | (side[x] != side[y]))
        x, y = x[good], y[good]
        for at in range(0, len(x), PAIRS):
            held.append((x[at:at + PAIRS], y[at:at + PAIRS]))
            if sum(len(v) for v, _ in held) >= PAIRS:
                yield from tested()
    yield from tested()


def _likely_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (block pair, node) of block pairs that have a surviving partner."""
    for table, starts in whole_groups(batches, "_pair"):
        rows = [v for pair in _likely_pairs(table, starts) for v in pair]
        rows = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
        yield table.select(["_pair", "node"]).take(pa.array(rows)).combine_chunks().to_batches()[0] if len(rows) else \
            pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["_pair", "node"])


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links, confirmed on the full sets, that join components: a spanning forest, likeliest pairs first."""
    for table, starts in whole_groups(batches, "_pair"):
        node, group = table.column("node").to_numpy(), table.column("component").to_pylist()
        items = table.column("items").to_pylist()
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while c in parent:
                c = parent[c]
            return c

        out = []
        for x, y in _likely_pairs(table, starts):
            for i, j in zip(x.tolist(), y.tolist()):
                one, two = root(group[i]), root(group[j])
                if one != two and _linked(items[i], items[j]):
                    parent[max(one, two)] = min(one, two)
                    out.append((int(node[i]), int(node[j])))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else
                                         [pa.array([], pa.int64())] * 2, ["a", "b"])


class _Candidates:
    """The steps that share the classes' signatures and sets."""

    def __init__(self, classes: DataFrame, texts: DataFrame):
        self.classes, self.texts = classes.select("node", "signs"), texts
        rows = classes.select("node", "signs").mapInArrow(tidy(_bands), "node long, key long, band int")
        bands = stored(rows, "minhash-bands")
        crowd = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))
        full = stored(bands.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min(crowd)["n"].alias("center"))
                      .where("held > 1"), "minhash-buckets")
        self.members = stored(bands.join(full, "key"), "minhash-members")
        needed = stored(self.members.select("node").distinct(), "minhash-needed")
        self.sets = stored(texts.join(needed, "node", "left_semi").mapInArrow(tidy(_sets), "node long, items binary"),
                           "minhash-sets")

    def _beside(self, pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
        """``pairs`` (a, b) with ``column`` of both sides."""
        one = values.select(F.col("node").alias("a"), F.col(column).alias("x"))
        two = values.select(F.col("node").alias("b"), F.col(column).alias("y"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links: sequential test of the signatures, then the full sets."""
        signed = self._beside(stored(pairs.select("a", "b"), "minhash-tried"), self.classes, "signs")
        likely = stored(signed.mapInArrow(tidy(_likely), "a long, b long"), "minhash-likely")
        return stored(self._beside(likely, self.sets, "items").mapInArrow(tidy(_confirmed), "a long, b long"), "minhash-links")

    def labelled(self, links: DataFrame) -> DataFrame:
        """Bucket members with their component so far."""
        joined = self.members.join(components(links), "node", "left")
        return stored(joined.withColumn("component", F.coalesce("component", "node")), "minhash-labelled")

    def best_mates(self) -> DataFrame:
        """Each class with the bucket center it shares most bands with."""
        shared = self.members.where("node <> center").groupBy("node", "center").agg(F.count(F.lit(1)).alias("n"))
        best = shared.groupBy("node").agg(F.max(F.struct("n", F.xxhash64("center").alias("h"), "center")).alias("m"))
        return best.select(F.least("node", "m.center").alias("a"), F.greatest("node", "m.center").alias("b")).distinct()

    def between(self, labelled: DataFrame, turn: int) -> DataFrame:
        """One pair for each component: with the component that most of its rows meet as a bucket's drawn center."""
        draw = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("n"), F.col("component").alias("c"))
        centers = labelled.groupBy("key").agg(F.min(draw).alias("m"), F.min("component").alias("x"),
                                              F.max("component").alias("y")).where("x <> y")
        centers = stored(centers.select("key", F.col("m.n").alias("center_node"), F.col("m.c").alias("center_group")),
                         "minhash-centers")
        met = labelled.join(centers, "key").where("component <> center_group")
        pair = F.struct(F.xxhash64("node", "center_node", F.lit(turn)).alias("h"), "node", F.col("center_node").alias("o"))
        shared = met.groupBy("component", "center_group").agg(F.count(F.lit(1)).alias("n"), F.min(pair).alias("p"))
        chosen = shared.groupBy("component").agg(F.max(F.struct("n", "p")).alias("m"))
        return chosen.select(F.least("m.p.node", "m.p.o").alias("a"), F.greatest("m.p.node", "m.p.o").alias("b")).distinct()

    def remaining(self, labelled: DataFrame) -> DataFrame:
        """Links that join components, out of every candidate pair of different components.

        Blocks are first compared by signatures alone; full sets are then sent to the block pairs for those rows only
        that have a likely partner there. Pairs are compared inside the blocks and never become rows.
        """
        counts = stored(labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")), "minhash-counts")
        size = F.struct("n", F.xxhash64("component").alias("h"), "component")
        keys = counts.groupBy("key").agg(F.max(size).alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
        keys = stored(keys.where("k > 1").select("key", F.col("m.component").alias("largest"), F.col("m.n").alias("big"),
                                                 (F.col("all") - F.col("m.n")).alias("small")), "minhash-mixed")
        met = stored(labelled.select("key", "band", "node", "component").join(keys, "key").join(self.classes, "node"), "minhash-met")
        # a bucket's largest component is only compared with the others, never with itself
        salt = F.xxhash64("node", F.lit("block"))
        met = met.withColumn("main", F.col("component") == F.col("largest"))
        rest_blocks, main_blocks = (F.ceil(F.col(c) / F.lit(BLOCK)).cast("int") for c in ("small", "big"))
        rest = pair_blocks(met.where("NOT main"), [F.col("key")], rest_blocks, salt)
        own = F.when(F.col("main"), F.pmod(salt, main_blocks)).otherwise(F.pmod(salt, rest_blocks)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("main"), rest_blocks).otherwise(main_blocks) - 1))
        across = met.withColumns({"_own": own, "_j": other})
        i = F.when(F.col("main"), F.col("_j")).otherwise(F.col("_own"))
        j = F.when(F.col("main"), F.col("_own")).otherwise(F.col("_j"))
        across = across.withColumns({"_pair": F.xxhash64("key", F.lit("main"), i, j), "_side": F.col("main").cast("int"),
                                     "_same": F.lit(False)})
        columns = ["_pair", "_side", "_same", "main", "band", "node", "component", "signs"]
        sent = stored(rest.where("small > 1").select(*columns).union(across.select(*columns)), "minhash-blocks")

        def by_pair(rows: DataFrame, more: list[str]) -> DataFrame:
            return rows.select(*columns, *more).repartition("_pair").sortWithinPartitions("_pair")

        likely = stored(by_pair(sent, []).mapInArrow(tidy(_likely_rows), "_pair long, node long"), "minhash-likely")
        left = stored(sent.join(likely, ["_pair", "node"], "left_semi"), "minhash-left").join(self.sets, "node")
        return stored(by_pair(left, ["items"]).mapInArrow(tidy(_joining), "a long, b long"), "minhash-links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id, n_shingles, component_id (least id reachable by links) and kept (it is that id)."""
    ship(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    base = stored(texts.mapInArrow(tidy(_base), "node long, n_shingles long, digest binary, signs binary"), "minhash-base")
    useful = base.where("digest IS NOT NULL AND node IS NOT NULL")
    classes = stored(useful.groupBy("digest").agg(F.min("node").alias("node"), F.first("signs").alias("signs")),
                     "minhash-classes")
    first = classes.select("digest", F.col("node").alias("rep"))
    repeated = useful.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = useful.select("node", "digest").join(repeated, "node").join(first, "digest").select(
        F.col("node").alias("a"), F.col("rep").alias("b"))
    steps = _Candidates(classes, texts.where("node IS NOT NULL"))
    links = stored(same.union(steps.links(steps.best_mates())), "minhash-links")
    for turn in range(ROUNDS):
        links = links.union(steps.links(steps.between(steps.labelled(links), turn)))
    links = links.union(steps.remaining(steps.labelled(links)))
    found = components(links).select(F.col("node").alias("rep"), "component")
    known = stored(first.join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id")),
                   "minhash-known")
    out = base.select("node", "n_shingles", F.when(F.col("node").isNotNull(), F.col("digest")).alias("digest")).join(
        known, "digest", "left")
    component = F.coalesce("component_id", "node")
    return out.select(F.col("node").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("node") == component, F.lit(True)).alias("kept"))


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with one row left of each component, unchanged; rows without an id all stay.

    Of rows that share a kept id, the one whose text has the least hash stays.
    """
    found = near_duplicates(df, id_col, text_col)
    kept = stored(found.where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct(),
                  "minhash-kept")
    rows = df.where(F.col(id_col).isNotNull()).select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"))
    order = W.partitionBy("_id").orderBy(F.xxhash64(f"_row.{text_col}"))
    one = rows.join(kept, "_id", "left_semi").withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return one.select("_row.*").unionByName(df.where(F.col(id_col).isNull()))
