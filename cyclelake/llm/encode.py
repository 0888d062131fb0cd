"""Token ids by the tokenizers library, with each distinct piece of text encoded once per Python worker.

Both supported kinds of vocabulary cut text at white space, so a text is encoded piece by piece:

* ``byte`` (byte-level BPE, white space kept): a cut before a space that follows a non-space character is always
  a token border, and the space leads the next piece;
* ``word`` (BPE with word ends, white space dropped): any white space is a border.

Arrow splits and numbers the pieces of a slice of texts. Pieces of ASCII letters, with or without a mark of punctuation, are looked
up in an Arrow table of words; the others are cut into the vocabulary's words by its pattern and looked up in a dictionary. The
library's model encodes each unseen word once, and numpy gathers the ids. Both tables are emptied at a number of entries,
which bounds a worker's memory.
Tests hold every path against the library's own ``encode``.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The Unicode White_Space characters (for Python and for RE2), and the pattern of byte-level BPE.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WHITE_RE2 = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A private-use character that stands between pieces, and the id that no vocabulary has.
MARK, MARK_ID = "\ue000", 0xFFFFFFFF

_RUN = f"[{_WHITE_RE2}] "
_CUT = re.compile(f"(?<![{WHITE}]) ")
LONG_TEXT = 4 << 20
MARKS = ".,;:!?"


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the
    rest numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class _Words:
    """Ids of words as Arrow and numpy columns: a word's ids begin at ``start`` in ``flat``."""

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, words: pa.Array, ids: list[bytes]) -> None:
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        self.words = pa.concat_arrays([self.words, words])


class PieceEncoder:
    def __init__(self, path: str, kind: str, max_tokens: int = 400_000, max_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if kind not in ("byte", "word"):
            raise ValueError(f"kind must be 'byte' or 'word', not {kind!r}")
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.kind, self.max_tokens, self.max_words = kind, max_tokens, max_words
        self.words: dict[str, _Words] = {}
        self.special = [x["content"] for x in config["added_tokens"]]
        self.model, self.normalizer = self.library.model, self.library.normalizer
        pattern = BYTE_PATTERN if kind == "byte" else config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_letters()))
        self.tokens = {MARK: np.array([MARK_ID], "<u4").tobytes()}

    def _odd(self, pieces: pa.Array) -> np.ndarray:
        """Pieces that must not stand beside others: special strings, outer white space, the mark."""
        odd = pc.match_substring_regex(pieces, f"^$|^[{_WHITE_RE2}]|[{_WHITE_RE2}]$|{MARK}")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(pieces, s))
        return odd.to_numpy(zero_copy_only=False)

    def _learn(self, token: str) -> bytes:
        """Ids of one word of the vocabulary's pattern, as the bytes of unsigned 32-bit integers."""
        if token.isascii() and token.lstrip(" ").isalpha():
            spelt = token.replace(" ", self.letters[32])
        else:
            spelt = token.encode().decode("latin-1").translate(self.letters)
        got = self.tokens[token] = array("I", [x.id for x in self.model.tokenize(spelt)]).tobytes()
        return got

    def _tokenize_plain(self, word: str, lead: str) -> bytes:
        """Ids of a word of ASCII letters."""
        return array("I", [x.id for x in self.model.tokenize(self.letters[32] + word if lead else word)]).tobytes()

    def _plain_table(self, pieces: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece of letters (and a mark) has, and the ids of all pieces, one after the other."""
        pieces = pc.ascii_lower(pieces) if self.kind == "word" else pieces
        stems = pc.utf8_rtrim(pieces, MARKS)
        known = self.words.setdefault(lead, _Words())
        if len(known.words) > self.max_words:
            known = self.words[lead] = _Words()
        place = pc.index_in(stems, value_set=known.words)
        unseen = place.is_null().to_numpy(zero_copy_only=False)
        slot = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if unseen.any():
            new = stems.filter(pa.array(unseen)).dictionary_encode()
            slot[unseen] = len(known.words) + new.indices.to_numpy(zero_copy_only=False)
            known.add(new.dictionary, [self._tokenize_plain(x, lead) for x in new.dictionary.to_pylist()])
        marks = [np.frombuffer(self.tokens.get(x) or self._learn(x), "<u4") for x in MARKS]
        mark = pc.index_in(pc.utf8_slice_codeunits(pieces, -1), value_set=pa.array(list(MARKS)))
        mark = mark.fill_null(-1).to_numpy(zero_copy_only=False)
        stem = known.length[slot]
        length = stem + np.array([*map(len, marks), 0])[mark]
        ends = np.cumsum(length)
        out = np.empty(int(length.sum()), np.uint32)
        begin, told = ends - length, np.cumsum(stem) - stem
        step = np.arange(stem.sum())
        out[np.repeat(begin - told, stem) + step] = known.flat[np.repeat(known.start[slot] - told, stem) + step]
        for i, ids in enumerate(marks):
            at = begin[mark == i] + stem[mark == i]
            out[at[:, None] + np.arange(len(ids))] = ids
        return length, out

    def _table(self, pieces: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece's ids begin in a flat table, how many they are, and the table."""
        if len(self.tokens) > self.max_tokens:
            self.tokens = {MARK: self.tokens[MARK]}
        begin, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        # pieces of ASCII letters are one word each, and a mark of punctuation after them is another
        plain = pc.match_substring_regex(pieces, f"^[A-Za-z]+[{MARKS}]?$").to_numpy(zero_copy_only=False)
        length[plain], flat = self._plain_table(pieces.filter(pa.array(plain)), lead)
        begin[plain] = np.cumsum(length[plain]) - length[plain]
        tables, get, learn = [flat], self.tokens.get, self._learn
        # the others are cut by the pattern, all in one text with marks between them
        odd = self._odd(pieces)
        mixed = ~(plain | odd)
        glue = f"\n{MARK}\n" if self.kind == "byte" else f" {MARK} "
        text = "".join([lead + x + glue for x in pieces.filter(pa.array(mixed)).to_pylist()])
        found = self.find(self.normalizer.normalize_str(text) if self.normalizer else text)
        tables.append(np.frombuffer(b"".join([get(x) or learn(x) for x in found]), "<u4"))
        marks, beside = np.flatnonzero(tables[1] == MARK_ID), int(self.kind == "byte")  # line feeds beside a mark
        start = np.concatenate([[0], marks + 1 + beside])[:-1]
        begin[mixed] = start + len(tables[0])
        length[mixed] = marks - beside - start
        alone = [self.library.encode(lead + x, add_special_tokens=False).ids
                 for x in pieces.filter(pa.array(odd)).to_pylist()]
        length[odd] = list(map(len, alone))
        begin[odd] = sum(map(len, tables)) + np.cumsum(length[odd]) - length[odd]
        return begin, length, np.concatenate([*tables, np.array([i for x in alone for i in x], "<u4")])

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts and, per text, the index of its first piece."""
        if self.kind == "word":
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            run = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
            if run.any():  # a run of white space that ends in a space stays in one piece
                split = [_CUT.split(t) if r else t.split(" ") for t, r in zip(texts.to_pylist(), run)]
                lists = pa.array(split, pa.list_(pa.string()))
            else:
                lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        return lists.flatten(), offsets - offsets[0]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (uint32 arrays); a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if len(texts) == 0:
            return []
        if len(texts) == 1 and len(texts[0].as_py()) > LONG_TEXT:
            return [self._encode_long(texts[0].as_py())]
        parts, starts = self._parts(texts)
        coded = parts.dictionary_encode()
        known, slot = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if self.kind == "byte":  # pieces after a text's first one begin with a space
            first = np.unique(slot[starts[:-1]])
            renamed = np.zeros(len(known), np.int64)
            renamed[first] = len(known) + np.arange(len(first))
            slot[starts[:-1]] = renamed[slot[starts[:-1]]]
            later, own = self._table(known, " "), self._table(known.take(pa.array(first)), "")
            begin = np.concatenate([later[0], own[0] + len(later[2])])
            length, table = np.concatenate([later[1], own[1]]), np.concatenate([later[2], own[2]])
        else:
            begin, length, table = self._table(known, "")
        length = length[slot]
        ends = np.cumsum(length)
        small = np.int32 if max(len(table), int(ends[-1])) < 1 << 31 else np.int64
        place = np.repeat((begin[slot] - ends + length).astype(small), length)
        place += np.arange(ends[-1], dtype=small)
        flat = table[place]
        return np.split(flat, np.concatenate([[0], ends])[starts[1:-1]])

    def _encode_long(self, text: str) -> np.ndarray:
        """A very long text in stretches that end at piece borders."""
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + LONG_TEXT // 2)
            end = cut.start() if cut else len(text)
            if end - at > LONG_TEXT:
                out.append(np.array(self.library.encode(text[at:end], add_special_tokens=False).ids, np.uint32))
            else:
                out += self.encode(pa.array([text[at:end]], pa.string()))
            at = end
        return np.concatenate(out)


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """This Python worker's encoder for a vocabulary file."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = PieceEncoder(path, kind)
    return _ENCODERS[path, kind]
