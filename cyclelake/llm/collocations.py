"""Operator 12, phrase collocation mining by HAT-trie counting.

1. A task counts the phrases of up to three words of its texts in one HAT-trie per language: hash containers under
   a shallow trie of word ids. A container of over ``BURST`` phrases of a few first words is burst by the second word. Beyond ``MAX_PHRASES`` phrases the largest subtrees are spilled whole, until half are left, and freed.
2. A spill is cut into *prefix partitions* (by the hash of the first two words, and of the third in 16, so that a hot pair
   is spread too) and written as sorted runs: the partition's words in order, and columns of word places and counts,
   compressed. All runs of a partition are merged in one task, whose size follows from the number of partitions (one
   per ``PARTITION_BYTES`` of text); phrases of at least ``least`` occurrences are kept, which loses nothing, as the
   parts of a candidate occur at least as often as the candidate.
3. Candidates meet the counts of their parts by shuffle joins on whole phrases; scores are exact (decimals of 38 digits,
   enough for counts below 10^15).

A-Z are lower-cased, a text is cut at ``.,;:!?`` and line ends into pieces, a piece at spaces and tabs into words; a
null or empty text has none; phrases don't cross pieces or texts. A null language counts as ``und`` (and with a language of that
name). Repeated rows count each time. Ties end at the phrase's bytes, and no two rows of a language share a phrase, so the
ranks are unique. Texts of any length are counted whole, in stretches. An empty table gives an empty table; no other column is read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, stored, text_slices, tidy
from .graph import whole_groups

LEAST, SHARE, FIRST = 10, 50, 2000
BURST, ROOTS, FAN, MAX_PHRASES, PARTITION_BYTES = 2048, 1024, 16, 1 << 20, 6 << 20
#: A phrase is one integer of three word ids of 21 bits; id 0 is no word. Tokens are added in stretches.
ID_BITS, MAX_WORDS, STRETCH, SLICE = 21, (1 << 21) - 1, 1 << 18, 4 << 20
SALT, GROUPS = 16, 256

_LOW = (1 << ID_BITS) - 1
#: Letters to lower-case; the ends of pieces become line feeds, tabs spaces.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


def tokens(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """The words of all texts as numbers, -1 where a piece or text ends, and the distinct words."""
    blob = "\n".join(texts).encode().translate(_FOLD).replace(b"\n", b" \n ")
    one = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(blob)], np.int32)), pa.py_buffer(blob)])
    coded = pc.split_pattern(one, " ").flatten().dictionary_encode()
    spelt, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    number = np.array([-2 if w == "" else -1 if w == "\n" else 0 for w in spelt], np.int64)
    number[number == 0] = np.arange((number == 0).sum())
    code = number[code]
    return code[code != -2], [w for w, n in zip(spelt, number.tolist()) if n >= 0]


class HatTrie:
    """Counts of phrases, each one integer of three word ids.

    The first level deals phrases by the first word's id (its low bits) to hash containers ``{phrase: count}``, so rare words share
    one; a container of over ``burst`` phrases bursts into ``FAN`` by the second word's id.
    """

    def __init__(self, burst: int = BURST):
        self.root: list[list[dict[int, int]]] = [[{}] for _ in range(ROOTS)]
        self.burst, self.size = burst, 0

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        """Count distinct phrases."""
        for slot, p, n in _dealt((phrases >> 2 * ID_BITS) % ROOTS, phrases, counts):
            held = self.root[slot]
            if len(held) == 1:
                self.size += self._count(held[0], p, n)
                if len(held[0]) > self.burst:
                    self.root[slot] = self._burst(held[0])
            else:
                for i, q, m in _dealt((p >> ID_BITS) % FAN, p, n):
                    self.size += self._count(held[i], q, m)

    @staticmethod
    def _count(held: dict[int, int], phrases: np.ndarray, counts: np.ndarray) -> int:
        if not held:
            held.update(zip(phrases.tolist(), counts.tolist()))
            return len(held)
        before, get = len(held), held.get
        for p, n in zip(phrases.tolist(), counts.tolist()):
            held[p] = get(p, 0) + n
        return len(held) - before

    @staticmethod
    def _burst(held: dict[int, int]) -> list[dict[int, int]]:
        node: list[dict[int, int]] = [{} for _ in range(FAN)]
        for p, n in held.items():
            node[(p >> ID_BITS) % FAN][p] = n
        return node

    def take(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Remove whole subtrees, the largest first, until at most ``keep`` phrases are left: phrases and counts."""
        phrases, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, slot in sorted(((sum(map(len, x)), i) for i, x in enumerate(self.root)), reverse=True):
            if self.size <= keep:
                break
            for held in self.root[slot]:
                phrases.append(np.fromiter(held, np.int64, len(held)))
                counts.append(np.fromiter(held.values(), np.int64, len(held)))
            self.root[slot] = [{}]
            self.size -= size
        return np.concatenate(phrases), np.concatenate(counts)


def _dealt(where: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """The rows of each value of ``where``."""
    order = np.argsort(where, kind="stable")
    sorted_ = where[order]
    starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist()):
        yield int(sorted_[a]), *(c[order[a:b]] for c in columns)


def columns_of(phrases: np.ndarray) -> np.ndarray:
    """The three word ids of each phrase."""
    return np.stack([phrases >> 2 * ID_BITS, phrases >> ID_BITS & _LOW, phrases & _LOW])


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class Counter:
    """The tries of one task, the ids of its words, and its sorted runs."""

    def __init__(self, partitions: int, most: int = MAX_PHRASES, burst: int = BURST):
        self.partitions, self.most, self.burst = partitions, most, burst
        self.clear()

    def clear(self) -> None:
        self.tries: dict[str, HatTrie] = {}
        self.ids: dict[str, int] = {}
        self.hashes = array("Q", [0])

    def number(self, word: str) -> int:
        """The task's id of a word, from 1."""
        known = self.ids.get(word)
        if known is None:
            known = self.ids[word] = len(self.ids) + 1
            self.hashes.append(_hash(word))
        return known

    def size(self) -> int:
        return sum(t.size for t in self.tries.values())

    def add(self, lang: str, texts: list[str]) -> Iterator[tuple]:
        """Count the phrases of some texts; runs come out when the tries are full."""
        code, spelt = tokens(texts)
        for at in range(0, len(code), STRETCH):
            part = code[at:at + STRETCH + 2]  # phrases begin in the stretch and may end two words behind it
            used = np.unique(part[part >= 0])
            if len(self.ids) + len(used) > MAX_WORDS:
                yield from self.spill(0)
                self.clear()
            own = np.zeros(len(spelt) + 1, np.int64)  # the last stands for -1
            own[used] = [self.number(spelt[i]) for i in used.tolist()]
            word = np.concatenate([own[part], [0, 0]])
            a, b, c = word[:-2][:STRETCH], word[1:-1][:STRETCH], word[2:][:STRETCH]
            a = a << 2 * ID_BITS
            two = (a > 0) & (b > 0)
            three = two & (c > 0)
            phrases = np.concatenate([a[a > 0], (a + (b << ID_BITS))[two], (a + (b << ID_BITS) + c)[three]])
            self.tries.setdefault(lang, HatTrie(self.burst)).add(*np.unique(phrases, return_counts=True))
            if self.size() > self.most:
                yield from self.spill(self.most // 2)

    def spill(self, keep: int) -> Iterator[tuple]:
        """Rows (partition, language, words in order, run): subtrees leave until ``keep`` phrases are left."""
        if not self.ids:
            return
        spelt = pa.array(list(self.ids), pa.string())
        order = pc.sort_indices(spelt).to_numpy().astype(np.int64)
        rank, ordered = np.zeros(len(order) + 1, np.int64), spelt.take(pa.array(order))
        rank[order + 1] = np.arange(1, len(order) + 1)
        hashes = np.array(self.hashes, np.uint64)[np.append(0, order + 1)]
        total = max(1, self.size())
        for lang, trie in self.tries.items():
            phrases, counts = trie.take(keep * trie.size // total)
            if len(phrases):
                yield from self._runs(lang, rank[columns_of(phrases)], counts, ordered, hashes)

    def _runs(self, lang: str, words: np.ndarray, counts: np.ndarray, ordered: pa.Array, hashes: np.ndarray) -> Iterator[tuple]:
        a, b, c = hashes[words]
        mixed = (a * np.uint64(3) + b * np.uint64(5) + np.uint64(_hash(lang)) + c % np.uint64(SALT)) * np.uint64(0x9E3779B97F4A7C15)
        where = ((mixed >> np.uint64(32)) * np.uint64(self.partitions) >> np.uint64(32)).astype(np.int64)
        phrase = (words[0] << 2 * ID_BITS) + (words[1] << ID_BITS) + words[2]
        line = np.argsort(phrase)
        line = line[np.argsort(where[line], kind="stable")]
        words, counts, where = words[:, line], counts[line], where[line]
        starts = np.flatnonzero(np.diff(where, prepend=-1))
        mark, place = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int32)
        for x, y in zip(starts.tolist(), np.append(starts[1:], len(where)).tolist()):
            own = words[:, x:y]
            mark[own] = True
            mark[0] = False
            used = np.flatnonzero(mark)
            mark[used] = False
            place[used] = np.arange(1, len(used) + 1)
            places = place[own]
            spelt = pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), ordered.take(pa.array(used - 1)))
            spelt = pc.binary_join(spelt, " ").cast(pa.binary())[0].as_py()
            run = places.astype("<i4").tobytes() + counts[x:y].astype("<i8").tobytes() + spelt
            yield int(where[x]), lang, y - x, len(run), pa.compress(run, "zstd", asbytes=True)


_RUN = {"part": pa.int64(), "lang": pa.string(), "phrases": pa.int64(), "bytes": pa.int64(), "run": pa.binary()}


def _counted(partitions: int, most: int, burst: int):
    """Arrow function (language, text): sorted runs of phrase counts by prefix partition."""

    def batch_of(row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _RUN.values())], list(_RUN))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(partitions, most, burst)
        for part in text_slices(batches, limit=SLICE):
            langs = part.column(0).dictionary_encode()
            where, texts = langs.indices.to_numpy(zero_copy_only=False), part.column(1)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                for row in counter.add(lang, texts.filter(pa.array(where == i)).to_pylist()):
                    yield batch_of(row)
        for row in counter.spill(0):
            yield batch_of(row)

    return rows


def merged_runs(runs: list[tuple[int, bytes]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of some runs (number of phrases, bytes) in order, and the distinct phrases as places (0 is none) with their
    whole counts."""
    spelt = pa.array([run[20 * n:] for n, run in runs], pa.binary()).cast(pa.string())
    lists = pc.split_pattern(spelt, " ")
    words, lengths = lists.flatten(), np.diff(lists.offsets.to_numpy())
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.zeros(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    place, offsets = rank[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(lengths) - lengths
    columns, counts = [], []
    for at, length, (n, run) in zip(offsets.tolist(), lengths.tolist(), runs):
        local = np.frombuffer(run, "<i4", 3 * n).reshape(3, n)
        columns.append(np.append(np.int32(0), place[at:at + length])[local])
        counts.append(np.frombuffer(run, "<i8", n, 12 * n))
    w, n = np.concatenate(columns, axis=1), np.concatenate(counts)
    pair = w[0].astype(np.int64) * (len(order) + 1) + w[1]
    del columns, counts, place, words
    line = np.lexsort((w[2], pair))  # a stable merge sort, to which each run is one ordered stretch
    w, n, pair = w[:, line], n[line], pair[line]
    starts = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(w[2], prepend=-1) != 0))
    return coded.dictionary.take(pa.array(order)), w[:, starts], np.add.reduceat(n, starts)


def _merged(least: int):
    """Arrow function over runs sorted by partition: rows (language, number of words, phrase, count).

    Rows of 0 words hold a part of the language's number of word occurrences.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, "part"):
            for a, b in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist()):
                own = table.slice(a, b - a)
                for lang in pc.unique(own.column("lang")).to_pylist():
                    one = own.filter(pc.equal(own.column("lang"), lang)).combine_chunks()
                    runs = [(n, pa.decompress(r, size, "zstd", asbytes=True)) for n, size, r in zip(
                        *(one.column(c).to_pylist() for c in ("phrases", "bytes", "run")))]
                    spelt, w, n = merged_runs(runs)
                    total = int(n[w[1] == 0].sum())
                    w, n = w[:, n >= least], n[n >= least]
                    parts = [spelt.take(pa.array(np.where(x > 0, x - 1, 0), mask=x == 0)) for x in w]
                    phrase = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
                    size = 1 + (w[1] > 0) + (w[2] > 0)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * (len(n) + 1), pa.string()), pa.array(np.append(size, 0).astype(np.int32)),
                        pa.concat_arrays([phrase, pa.nulls(1, pa.string())]), pa.array(np.append(n, total))],
                        ["lang", "size", "phrase", "n"])

    return rows


def phrase_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                  partitions: int | None = None, most: int = MAX_PHRASES, burst: int = BURST) -> DataFrame:
    """(lang, size, phrase, n): every phrase of one to three words that occurs ``least`` times, and rows of size 0."""
    ship(df.sparkSession)
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                      F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    if partitions is None:
        partitions = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PARTITION_BYTES
    runs = texts.mapInArrow(tidy(_counted(partitions, most, burst)), "part long, lang string, phrases long, bytes long, run binary")
    merged = runs.repartition("part").sortWithinPartitions("part").mapInArrow(
        tidy(_merged(least)), "lang string, size int, phrase string, n long")
    return stored(merged, "phrase-counts")


def _ratio(a: str, l: str, r: str) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole decimals."""
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(16,0)) * CAST({a} AS DECIMAL(15,0))) "
                  f"div (CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0)))")


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, share: int = SHARE,
                 first: int = FIRST, **counting) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score.

    ``share``: a phrase is dropped that lies in a longer candidate of at least so many percent of its occurrences.
    """
    counts = phrase_counts(df, lang_col, text_col, least, **counting)
    known = counts.where("size > 0").select("lang", "phrase", "n")
    candidates = counts.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    longer = candidates.where(F.size("w") == 3).select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"))
    over = stored(longer.groupBy("lang", "phrase").agg(F.max("a").alias("over")), "phrase-over")
    alone = candidates.join(over, ["lang", "phrase"], "left").where(
        F.col("over").isNull() | (F.lit(100) * F.col("over") < F.lit(share) * F.col("a")))
    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("tail"))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", _ratio("a", "l", "r"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m"))
    best = best.select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's phrases are first cut down in groups by hash
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    near = best.withColumn("_group", group).withColumn("_place", F.row_number().over(W.partitionBy("lang", "_group").orderBy(*order)))
    near = near.where(F.col("_place") <= first).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    totals = stored(counts.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    return near.where(F.col("rank") <= first).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
