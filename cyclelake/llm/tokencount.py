"""Operator 4, token counts by compiled finite-state transducers.

Two deterministic transducers stand for a byte-level BPE vocabulary:

* the *border* transducer reads character classes (with two classes of lookahead in its input letter) and marks
  where the vocabulary's pattern starts a new word. It has seven states, so a chunk of text is a map from seven
  states to seven; the maps of all chunks are computed side by side and composed by a parallel prefix scan, which
  gives every chunk its start state;
* the *merge* transducer reads bytes. Its state holds what can still become the last token of a prefix: the open
  trie positions, the token before each, and that prefix's count relative to the current one. A token may follow
  another only if merging the two by rank leaves both as they are. Each transition emits the change of the token
  count (1, 0 or negative when a longer token replaces several), so a text's count is the sum of its emissions.
  States and transitions are compiled when first met, into a table that is emptied at ``MAX_CELLS``; chunks begin
  at borders, where the state is always the root, so their maps are constants that compose by addition.

Chunks of many texts advance in step through the tables by numpy. Defined results: a null or empty text has 0 bytes
and 0 tokens; special strings inside a text count as one token each, as the library's default does; every row counts
by itself (repeated rows too); other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_slices
from .encode import WHITE, byte_letters

# Character classes: letters that matter in contractions have one of their own.
_LETTERS = "stmdrevl"
LETTER, NUMBER, SPACE, WHITESPACE, QUOTE, OTHER, END = 8, 9, 10, 11, 12, 13, 14
CLASSES = 15
# States of the border transducer: START after a finished word, then inside a run of letters, numbers, others or
# white space, after a space that leads the next word, and before the last one or two letters of a contraction.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, LEAD, ONE_MORE, TWO_MORE = range(8)
STATES = 8
CHUNK, LANE, MAX_CELLS = 256, 192, 1 << 25
#: Pairs of tokens whose merging is remembered.
MAX_FITS = 1 << 18


def class_table() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            kinds[point] = LETTER
        elif kind == "N":
            kinds[point] = NUMBER
    white = re.compile(f"[{WHITE}]")
    for point in range(0x3001):
        if white.match(chr(point)):
            kinds[point] = WHITESPACE
    kinds[ord(" ")], kinds[ord("'")] = SPACE, QUOTE
    for k, letter in enumerate(_LETTERS):
        kinds[ord(letter)] = k
    return kinds


def border_table() -> np.ndarray:
    """next state * 2 + border-before flag, by state and input letter (class, next class, the one after it).

    Two more input letters follow: each letter once more for a text's first character (which starts from START
    whatever the state), and one that changes nothing.
    """
    letter = lambda c: c <= LETTER
    pair = {("r", "e"), ("v", "e"), ("l", "l")}
    name = lambda c: _LETTERS[c] if c < LETTER else None

    def step(state: int, c: int, after: int, then: int) -> int:
        if state == TWO_MORE:
            return ONE_MORE * 2
        if state == ONE_MORE:
            return START * 2
        if c in (SPACE, WHITESPACE):
            if after in (SPACE, WHITESPACE, END):
                return IN_WHITE * 2 + (state != IN_WHITE)
            return (LEAD if c == SPACE else START) * 2 + 1
        if letter(c):
            return IN_LETTERS * 2 + (state not in (IN_LETTERS, LEAD))
        if c == NUMBER:
            return IN_NUMBERS * 2 + (state not in (IN_NUMBERS, LEAD))
        if state in (IN_OTHERS, LEAD):
            return IN_OTHERS * 2
        if c == QUOTE and name(after) and name(after) in "stmd":
            return ONE_MORE * 2 + 1
        if c == QUOTE and (name(after), name(then)) in pair:
            return TWO_MORE * 2 + 1
        return IN_OTHERS * 2 + 1

    n = CLASSES ** 3
    table = np.zeros((STATES, 2 * n + 1), np.uint8)
    for c in range(CLASSES - 1):
        for after in range(CLASSES):
            for then in range(CLASSES):
                at = (c * CLASSES + after) * CLASSES + then
                for state in range(STATES):
                    table[state, at] = step(state, c, after, then)
                table[:, n + at] = step(START, c, after, then) | 1
    table[:, 2 * n] = np.arange(STATES) * 2
    return table


class MergeTransducer:
    """The merge transducer of a byte-level BPE vocabulary, compiled as it is met."""

    def __init__(self, vocab: dict[str, int], merges: list):
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        spell = lambda s: bytes(byte_of[c] for c in s)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.rank = {(spell(a), spell(b)): r for r, (a, b) in enumerate(pairs)}
        self.spelling: list[bytes] = []
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.fits: dict[tuple[int, int], bool] = {}
        reachable = {bytes([b]) for b in range(256)}.union(a + b for a, b in self.rank)
        for word in sorted(reachable):
            if len(self.merged(word)) == 1:
                node = 0
                for b in word:
                    node = self.children[node].setdefault(b, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                        self.token_at.append(-1)
                self.token_at[node] = len(self.spelling)
                self.spelling.append(word)
        self.clear()

    def merged(self, word: bytes) -> list[bytes]:
        """The tokens of ``word``: the lowest-ranked neighbours merge first."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, before: int, token: int) -> bool:
        got = self.fits.get((before, token))
        if got is None:
            if len(self.fits) >= MAX_FITS:
                self.fits = {}
            a, b = self.spelling[before], self.spelling[token]
            got = self.fits[before, token] = self.merged(a + b) == [a, b]
        return got

    def clear(self) -> None:
        self.fits = {}
        root = ((0, -1, 0),)
        self.state_of, self.states = {root: 0}, [root]
        self.column, self.bytes = np.full(256, -1, np.int64), []  # bytes met so far have a column each
        self.table = np.full((1 << 10, 64), -1, np.int32)  # target * 32 + emission + 16, or -1

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The column of each byte; new ones are added."""
        for byte in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[byte] < 0:
                self.column[byte] = len(self.bytes)
                self.bytes.append(byte)
        if len(self.bytes) > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            return self.columns(data)
        return self.column[data]

    def compile(self, state: int, column: int) -> None:
        """Work out one transition."""
        kept, last, change, byte = [], -1, 0, self.bytes[column]
        for node, before, ahead in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if token >= 0 and (before < 0 or self.may_follow(before, token)):
                last, change = token, ahead + 1
            if self.children[child]:
                kept.append((child, before, ahead))
        target = (*((child, before, ahead - change) for child, before, ahead in kept), (0, last, 0))
        number = self.state_of.get(target)
        if number is None:
            number = self.state_of[target] = len(self.states)
            self.states.append(target)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        if not -16 <= change < 16:
            raise OverflowError("emission out of range")
        self.table[state, column] = number * 32 + change + 16

    def advance(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The table's entries for one step of many lanes."""
        got = self.table.reshape(-1)[state * self.table.shape[1] + column]
        if got.min() < 0:
            new = got < 0
            for x in np.unique(state[new] * 256 + column[new]).tolist():
                self.compile(x >> 8, x & 255)
            got = self.table.reshape(-1)[state * self.table.shape[1] + column]
        return got

    def count(self, data: np.ndarray, border: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each chunk: chunks begin at ``starts`` (borders), one ends where the next begins."""
        if len(self.states) * self.table.shape[1] > MAX_CELLS:
            self.clear()
        data = self.columns(data)
        sizes = np.diff(np.append(starts, len(data)))
        order = np.argsort(-sizes, kind="stable")
        begin, size = starts[order], sizes[order]
        state, total = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right") if len(size) else ()
        for k, lanes in enumerate(live):
            at = begin[:lanes] + k
            now = state[:lanes]
            now[border[at]] = 0
            got = self.advance(now, data[at])
            state[:lanes] = got >> 5
            total[:lanes] += (got & 31) - 16
            if lanes <= 4 and k > 4 * LANE:  # a few words of unusual length are left: follow each by itself
                for lane in range(lanes):
                    rest = slice(begin[lane] + k + 1, begin[lane] + size[lane])
                    total[lane] += self._follow(int(state[lane]), data[rest].tolist(), border[rest].tolist())
                break
        out = np.empty_like(total)
        out[order] = total
        return out

    def _follow(self, state: int, columns: list[int], fresh: list[bool]) -> int:
        total = 0
        for column, border in zip(columns, fresh):
            state = 0 if border else state
            if self.table[state, column] < 0:
                self.compile(state, column)
            got = int(self.table[state, column])
            state, total = got >> 5, total + (got & 31) - 16
        return total


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (chunk, state): after k rounds an entry covers 2**k chunks."""
    reach = 1
    while reach < len(maps):
        later = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), axis=1)
        maps = np.concatenate([maps[:reach], later])
        reach *= 2
    return maps


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if config["pre_tokenizer"]["type"] != "ByteLevel" or config["normalizer"] or config["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        self.classes, self.borders = class_table(), border_table()
        self.merge = MergeTransducer(config["model"]["vocab"], config["model"]["merges"])
        special = sorted((x["content"] for x in config["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def border_flags(self, points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where words begin; ``first`` and ``last`` are the places of the texts' first and last characters."""
        n = CLASSES ** 3
        kind = self.classes[points].astype(np.int32)
        after, then = np.append(kind[1:], END), np.append(kind[2:], [END, END])[:len(kind)]
        after[last] = END
        then[last] = END
        then[np.setdiff1d(last - 1, last)] = END  # of a text of one character, the place before belongs to another
        letter = (kind * CLASSES + after) * CLASSES + then
        letter[first] += n
        chunks = -(-len(letter) // CHUNK)
        grid = np.append(letter, np.full(chunks * CHUNK - len(letter), 2 * n)).reshape(chunks, CHUNK).T.copy()
        table, width = self.borders.reshape(-1), self.borders.shape[1]
        ends = np.tile(np.arange(STATES), (chunks, 1))
        for row in grid:  # every chunk from every state
            ends = (table[ends * width + row[:, None]] >> 1).astype(np.int64)
        start = np.append(START, compose(ends)[:-1, START])
        flags = np.empty(grid.shape, bool)
        for k, row in enumerate(grid):
            got = table[start * width + row]
            start, flags[k] = (got >> 1).astype(np.int64), got & 1
        return flags.T.reshape(-1)[:len(letter)]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts, owner, counts = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                own = self.special.split(text)
                counts[i] += len(own) - 1
                own = [x for x in own if x]
            else:
                own = [text] if text else []
            parts += own
            owner += [i] * len(own)
        if not parts:
            return counts
        joined = "".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        first = np.append(0, ends[:-1])
        flags = self.border_flags(np.frombuffer(joined.encode("utf-32-le"), np.uint32), first, ends - 1)
        data = np.frombuffer(joined.encode(), np.uint8)
        place = np.flatnonzero(data & 0xC0 != 0x80)  # the first byte of each character
        border = np.zeros(len(data), bool)
        border[place[flags]] = True
        # a chunk begins at a text's start, and at the first border after each multiple of LANE
        words = np.flatnonzero(border)
        fresh = np.append(True, words[1:] // LANE != words[:-1] // LANE)
        fresh[np.searchsorted(words, place[first])] = True
        starts = words[fresh]
        sums = self.merge.count(data, border, starts)
        np.add.at(counts, np.array(owner)[np.searchsorted(place[first], starts, side="right") - 1], sums)
        return counts


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """This Python worker's transducers for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """Per row of ``df``: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""
    ship(df.sparkSession)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(tokenizer)
        for part in text_slices(batches, limit=4 << 20):
            texts = pc.fill_null(part.column(1).cast(pa.string()), "")
            tokens = machine.count(texts.to_pylist())
            columns = [part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens),
                       pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(rows, schema)
