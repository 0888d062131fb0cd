"""The operators' local parts against brute force: encoders, transducers, blocks, alignment, bounds, packing."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from cyclelake.llm import langid, license_scan, minhash_dedup, packing, tokencount, tokenfile
from cyclelake.llm.encode import PieceEncoder

ALPHABET = " \n\t'abSsrevlt1٣é́ !<|>\x1c\x85ll　"
WEIRD = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "x<|endoftext|> y", "<|startoftext|>A  <|endoftext|>",
         "don't  you'll 's\n's", "'s's 're'ver 'r 'l", "\x1c b", "é é ́b", "ΑΣ σς", "\t\t x", "a" * 3000, " " * 2000]


def weird(n: int) -> list[str]:
    rng = random.Random(3)
    return WEIRD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_library(name, kind):
    own, texts = PieceEncoder(public_tokenizers.path(name), kind), weird(3000)
    for got, want in zip(own.encode(pa.array(texts)), own.library.encode_batch_fast(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids
    assert own.encode(pa.array([None, "x"], pa.string()))[0].tolist() == []
    assert own.encode(pa.array([], pa.string())) == []


def test_encoder_on_very_long_text(monkeypatch):
    from cyclelake.llm import encode

    monkeypatch.setattr(encode, "LONG_TEXT", 200)
    own = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), "byte")
    for text in ("one two  three\n four " * 100, "x" * 1000, " " * 500 + "a b" * 300):
        assert own.encode(pa.array([text]))[0].tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_token_counter_equals_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library, texts = tokencount.TokenCounter(path), PieceEncoder(path, "byte").library, weird(3000)
    want = [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want
    assert counter.count([]).tolist() == [] and counter.count([""]).tolist() == [0]
    counter.merge.clear()  # an emptied table is compiled anew
    assert counter.count(texts).tolist() == want


def test_remembered_pairs_are_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "MAX_FITS", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library, texts = tokencount.TokenCounter(path), PieceEncoder(path, "byte").library, weird(300)
    assert counter.count(texts).tolist() == [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert 0 < len(counter.merge.fits) <= 50
    counter.merge.clear()
    assert not counter.merge.fits


def test_state_maps_compose_in_order():
    rng = np.random.default_rng(1)
    maps = rng.integers(0, 5, (13, 5))
    want, now = [], np.arange(5)
    for m in maps:
        now = m[now]
        want.append(now)
    assert (tokencount.compose(maps) == np.array(want)).all()


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_segment_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.uint32)
    ids[rng.random(n) < 0.03] = 2 ** 32 - 1
    data = tokenfile.encode_segment(ids)
    assert (tokenfile.decode_segment(data) == ids).all()
    if n > 1024:
        assert (tokenfile.decode_segment(data, 1, 2) == ids[1024:2048]).all()
    if n == 5000:
        assert len(data) < 2.2 * n  # nine bits an id, exceptions aside


def test_packer_places_every_id_once_and_pads_nothing():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 1000, n).astype(np.uint32) for n in [1, 1, 7, 64, 65, 63, 128, 129, 1000, 640, *rng.integers(1, 90, 60)]]
    packer, rows = packing.Packer(64, 256, 0), []
    for at in range(0, len(docs), 20):
        packer.add(list(range(at, min(at + 20, len(docs)))), docs[at:at + 20])
        rows += packer.rows()
    packer.finish()
    rows += packer.rows()
    for k, ids in enumerate(docs):
        at = 0
        for _, start, n, crc, total, *_ in sorted(r for r in rows if r[0] == k):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[at:at + n].tobytes()))
            at += n
        assert at == len(ids)
    sizes = Counter()
    for r in rows:
        sizes[r[5]] += r[2]
    assert all(n <= 64 and n & (n - 1) == 0 for n in sizes.values())
    for s in sizes:
        at = 0
        for r in sorted((r for r in rows if r[5] == s), key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]


def brute_subwords(text: str) -> list[int]:
    data = (" " + text.lower() + " ").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     "))
    out = []
    for n in langid.ORDERS:
        for i in range(len(data) - n + 1):
            gram = data[i:i + n]
            if 32 not in gram[1:-1] and gram != b"  ":
                h = 0x811C9DC5
                for c in gram:
                    h = ((h ^ (c + 1)) * 0x01000193) & 0xFFFFFFFF
                out.append(((h * 0x9E3779B1) & 0xFFFFFFFF) >> 16)
    return sorted(out)


def test_subword_features_equal_brute_force():
    texts = ["Hallo du  da", "", "é a", "x", None, "\n\nab\tcd", "é"]
    hashed, count = langid.features(pa.array(texts))
    for text, part in zip(texts, np.split(hashed, np.cumsum(count)[:-1])):
        assert sorted(part.tolist()) == brute_subwords(text or "")


def brute_shingles(text: str | None) -> set:
    fold = {c: c + 32 for c in range(65, 91)}
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_shingles_and_signatures():
    rng = random.Random(9)
    texts = [None, "", " \n", "A b", "a B", "b a", "É é x"] + [
        " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    sets = minhash_dedup.shingles(pa.array(texts))
    brute = [brute_shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in brute]
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(brute[i] & brute[j])
    sliced = minhash_dedup.shingles(pa.array(texts).slice(3, 4))
    assert [s.tolist() for s in sliced] == [s.tolist() for s in sets[3:7]]
    items = np.unique(np.random.default_rng(1).integers(0, 2 ** 63, 5000, dtype=np.uint64))
    halves = minhash_dedup.signature(items[:2500]), minhash_dedup.signature(items[2500:])
    assert (np.minimum(*halves) == minhash_dedup.signature(items)).all()


def test_sequential_test_prunes_by_posterior():
    for k, m in enumerate(minhash_dedup.fewest_matches()):
        n = (k + 1) * minhash_dedup.BATCH
        reach = lambda x: sum(math.comb(n + 1, i) * .75 ** i * .25 ** (n + 1 - i) for i in range(x + 1))
        assert reach(m) >= minhash_dedup.MISS and (m == 0 or reach(m - 1) < minhash_dedup.MISS)
    a = np.random.default_rng(2).integers(0, 2 ** 32, (3, minhash_dedup.HASHES), dtype=np.uint32)
    b = a.copy()
    b[1, 10:] += 1  # nearly nothing in common
    b[2, ::5] += 1  # four fifths
    assert minhash_dedup.survivors(a, b).tolist() == [0, 2]


def longest_common(a: list[str], b: list[str]) -> int:
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    return best[-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= longest_common(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert license_scan.align(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("values", [[], [1], [3, 1, 2], [1, 1, 1], [5, 4, 3], [2, 5, 3, 7, 11, 8, 10, 13, 6]])
def test_longest_increasing(values):
    got = [values[i] for i in license_scan.longest_increasing(values)]
    want = 0
    for mask in range(1 << len(values)):
        some = [v for k, v in enumerate(values) if mask >> k & 1]
        if all(x < y for x, y in zip(some, some[1:])):
            want = max(want, len(some))
    assert len(got) == want and got == sorted(set(got))


def test_templates_are_found_in_repeated_and_long_texts():
    known = license_scan.Template("mit", license_scan.TEMPLATES["mit"], 0.8)
    words = license_scan.WORD.findall(license_scan.TEMPLATES["mit"].lower())
    for before, after, times in ((0, 0, 1), (3000, 10, 1), (5, 4000, 3), (17, 23, 2), (40, 9, 12)):
        found = known.places(["filler"] * before + words * times + ["filler"] * after, 0.8)
        n = len(words)
        assert found == [(n, before + i * n, before + (i + 1) * n) for i in range(times)]
    worn = [w for i, w in enumerate(words) if i % 7]
    assert known.places(worn, 0.8)[0][0] >= 0.8 * len(words)
    assert known.places(["filler"] * 100, 0.8) == []


def test_coverage_is_no_more_than_the_longest_common_subsequence_and_all_of_it_for_distinct_words():
    rng = np.random.default_rng(5)
    template = [f"w{i}" for i in range(40)]
    for _ in range(200):  # distinct words: the alignment is the longest common subsequence
        text = [w for w in template if rng.random() > 0.3]
        for at in sorted(rng.integers(0, len(text) + 1, 10), reverse=True):
            text.insert(at, "other")
        if len(text) > 4 and rng.random() < 0.5:
            i, j = sorted(rng.choice(len(text), 2, replace=False))
            text[i], text[j] = text[j], text[i]
        longest = np.zeros((len(text) + 1, len(template) + 1), int)
        for i, x in enumerate(text):
            for j, y in enumerate(template):
                longest[i + 1, j + 1] = longest[i, j] + 1 if x == y else max(longest[i, j + 1], longest[i + 1, j])
        assert len(license_scan.align(text, template)) == longest[-1, -1]


def test_holders_against_all_pairs():
    rng = np.random.default_rng(8)
    for _ in range(300):
        hits = [(f"t{rng.integers(4)}", int(rng.integers(1, 6)), int(rng.integers(6, 9)), int(a), int(a + rng.integers(1, 8)))
                for a in rng.integers(0, 12, rng.integers(1, 9))]
        rank = lambda h: (h[1], -h[2])
        want = []
        for h in hits:
            over = [o for o in hits if o[3] <= h[3] and o[4] >= h[4] and rank(o) > rank(h)]
            want.append(max(over, key=lambda o: (rank(o), o[0]))[0] if over else None)
        assert license_scan.holders(hits) == want


@pytest.mark.parametrize("before", [0, 700, 1111, 2500])
def test_interleaved_copies_are_found_among_recurring_keys(before):
    known = license_scan.Template("mit", license_scan.TEMPLATES["mit"], 0.8)
    n, key = len(known.words), max(known.keys, key=len)
    copy = [x for w in known.words for x in (w, "other")][:-1]
    text = ["filler"] * before + copy + ["filler"] * (3000 - before)
    assert known.places(text, 0.8)
    often = [key if x == "filler" and i % n == 0 else x for i, x in enumerate(text)]
    assert known.places(often, 0.8)
    for a, b in known.windows(often):
        assert b - a <= 4 * n
    for at in range(0, len(often) - 2 * n, 50):
        if before - n < at < before + n:
            assert any(a <= at and at + 2 * n <= b for a, b in known.windows(often))
