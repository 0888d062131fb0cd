"""Line dedup, collocations and hard negatives against brute force, on hand-made tables and the small test tables."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cyclelake.llm import collocations, hard_negatives, line_dedup, queries

SMALL = "/root/testdata/sf0.001"
LINE = "A line that is long enough to be a repeated one"
SPACE = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows, least_chars=40, least_docs=5):
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(SPACE))
            if doc is not None and len(key) >= least_chars:
                held.setdefault(key, set()).add(doc)
    often = {k: max(d) for k, d in held.items() if len(d) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or often.get(lowered(x.strip(SPACE)), doc) == doc]
        out.append((doc, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows():
    rng = random.Random(5)
    wide = "é" * 38 + "ΑΣ"  # 40 code points, and letters that are not A-Z
    pool = [LINE, LINE.upper(), f"\t {LINE} \x0b", "x" * 39, "x" * 40, wide, wide.lower(), "", "short", LINE + "\x85", "b" * 50]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(7, LINE), (7, "another text of the same id\n" + "x" * 40), (None, LINE), (None, None), (100, None), (101, ""),
             (102, "\n\n"), (5, rows[5][1]), (5, rows[5][1]), (103, "\n".join([f"only here {i} " * 5 for i in range(20000)] + [LINE]))]
    return rows


@pytest.mark.parametrize("segments,docs", [(None, 5), (7, 5), (3, 2), (1, 60)])
def test_frequent_lines_go(spark, segments, docs):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumns(
        {c: F.lit("clash") for c in ("row", "hash", "key", "id", "_row", "_keys", "n_lines", "a.b")})
    got = line_dedup.drop_lines(df, least_docs=docs, segments=segments)
    assert got.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rank = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2], r[3])
    found = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
    assert sorted(found, key=rank) == sorted(brute_lines(rows, 40, docs), key=rank)


def test_no_lines(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_lines(df).collect() == []


def test_filters_hold_every_repeat():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64)
    deltas = [(line_dedup._ONCE if i % 4 else line_dedup._TWICE, np.unique(rng.choice(pool, 9_000))) for i in range(12)]
    times = Counter(h for _, x in deltas for h in x.tolist())
    sure = {h for kind, x in deltas if kind == line_dedup._TWICE for h in x.tolist()}
    wrong = 0
    for (kind, hashes), found in zip(deltas, line_dedup.suspected(deltas)):
        for h, f in zip(hashes.tolist(), found.tolist()):
            assert f or (times[h] == 1 and h not in sure)
            wrong += f and times[h] == 1 and h not in sure
    assert wrong < 0.01 * len(times)


def test_segments_are_even():
    rng = np.random.default_rng(4)
    held = np.bincount(line_dedup.segment_of(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64), 10).astype(int), minlength=10)
    assert len(held) == 10 and held.min() > 4500 and held.max() < 5500


def brute_phrases(rows, least, share=50, first=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            totals[lang] += len(w)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    counts[lang, tuple(w[i:i + n])] += 1
    candidates = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    inside = Counter()
    for (lang, p), n in candidates.items():
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                inside[lang, q] = max(inside[lang, q], n)
    out = {}
    for (lang, p), a in candidates.items():
        if (lang, p) in inside and 100 * inside[lang, p] >= share * a:
            continue
        best = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        cut = p[:best[1]], p[best[1]:]
        out.setdefault(lang, []).append((-best[0], -a, " ".join(p).encode(), counts[lang, cut[0]], counts[lang, cut[1]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, x in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(x)[:first]))


def phrase_rows():
    rng = random.Random(8)
    pool = ["the", "The", "red", "fox", "é", "E", "ΑΣ", "naïve", "　", "x.y", "a,b", "one", "two", "und", "\x00", "'s"]
    rows = [(rng.choice(["en", "en", "en", None, "und", "é"]), "".join(
        rng.choice(pool) + rng.choice([" ", " ", " ", "  ", "\t", "\n", ". ", "\x0b", "\xa0"]) for _ in range(rng.randint(0, 80))))
        for _ in range(120)]
    return rows + [("en", None), ("en", ""), (None, None), ("de", " \t "), ("de", "..."), ("en", "hot pair " * 30000), ("xx", "solo")]


@pytest.mark.parametrize("least,most,burst,partitions,first", [(10, 1 << 20, 2048, None, 2000), (2, 300, 4, 7, 2000), (1, 50, 1, 40, 25)])
def test_collocations(spark, least, most, burst, partitions, first):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({c: F.lit(1) for c in ("n", "phrase", "a", "size")})
    got = collocations.collocations(df, least=least, first=first, most=most, burst=burst, partitions=partitions)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, first=first)


def test_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_trie_counts_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(collocations, "STRETCH", 100)
    rng = random.Random(1)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(3000)]
    counter, out = collocations.Counter(5, most=200, burst=3), []
    for i in range(0, 3000, 500):
        out += counter.add("en", [" ".join(words[i:i + 500])])
        assert all(t.size == sum(len(c) for x in t.root for c in x) for t in counter.tries.values()) and counter.size() <= 200
        assert any(len(x) > 1 for t in counter.tries.values() for x in t.root)
    out += counter.spill(0)
    got = Counter()
    for part in {r[0] for r in out}:
        runs = [r for r in out if r[0] == part]
        spelt, w, n = collocations.merged_runs([(r[2], pa.decompress(r[4], r[3], "zstd", asbytes=True)) for r in runs])
        assert (np.diff([sum(int(x) << 20 * (2 - i) for i, x in enumerate(c)) for c in w.T]) > 0).all()
        for c, k in zip(w.T.tolist(), n.tolist()):
            phrase = tuple(spelt[x - 1].as_py() for x in c if x)
            assert phrase not in got  # a phrase lies in one partition
            got[phrase] = k
    want = Counter(tuple(words[j:j + n]) for i in range(0, 3000, 500) for n in (1, 2, 3) for j in range(i, i + 500 - n + 1))
    assert got == want


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**14 - 1, 10**14 + 7, 10**15), (123456789012345, 123456789012345, 123456789012346), (10, 10, 10)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(collocations._ratio("a", "l", "r").alias("s")).collect()
    assert [x["s"] for x in got] == [1000000 * a * a // (l * r) for a, l, r in rows]


def test_intervals_hold_every_score():
    rng = np.random.default_rng(2)
    for size in (1, 3, 64, 100):
        v = rng.integers(-300, 300, (400, size))
        v[:3] = np.array([[0], [1], [-255]])
        a = np.concatenate([v[:20], rng.integers(-5, 5, (20, size))])
        turn = hard_negatives.rotation(size)
        assert np.allclose(turn @ turn.T, np.eye(size))
        low, high = hard_negatives.intervals(*hard_negatives.encode(v.astype(float), turn), a.astype(float), turn)
        exact = a @ v.T
        assert (low <= exact).all() and (exact <= high).all()
        if size == 100:
            assert (high - low).mean() < 2 * np.sqrt((a * a).sum(1)).mean() * np.sqrt((v * v).sum(1)).mean()


def brute_negatives(rows, positives=5, negatives=10):
    good = []
    for i, x, label in rows:
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        e = [math.floor(256 * c) for c in x]
        if len(e) * max(map(abs, e)) ** 2 < 2 ** 63:
            good.append((i, e, label))
    out = []
    for n, (i, e, label) in enumerate(good):
        if i % 10:
            continue
        scored = [(-sum(map(int.__mul__, e, f)), j, m) for k, (j, f, m) in enumerate(good) if k != n and len(e) == len(f)]
        for p, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            near = sorted(x for x in scored if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p)[:negatives]
            out += [(i, j, k + 1, m, -p, -s) for k, (s, m, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("anchors,blocks", [(1024, 2048), (3, 7)])
def test_hard_negatives(spark, monkeypatch, anchors, blocks):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "ROWS", blocks)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=6) + (i % 3)], int(i % 4)) for i in range(150)]
    rows += [(200 + i, rows[3 * i][1], 1) for i in range(10)] + [(300, rows[0][1], 0), (300, rows[8][1], 0), (310, [0.0] * 6, 2)]
    rows += [(400, None, 1), (410, [], 1), (420, [1.0, None], 1), (430, [float("nan")] * 6, 1), (440, [float("inf")] * 6, 1),
             (450, [1.0] * 6, None), (None, [1.0] * 6, 1), (460, [1.0, 2.0, 3.0], 1), (461, [1.0, 2.0, 3.5], 1),
             (462, [0.5, 1.0, 1.5], 2), (470, [1e30] * 6, 1), (480, [1e6] * 6, 3), (-10, [1.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4).withColumns(
        {c: F.lit("clash") for c in ("row", "vec", "score", "size", "pair", "found", "anchor")})
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_line_query_hashes_what_is_kept(spark):
    got = queries.QUERIES["op13_line_dedup"](spark, SMALL).collect()
    rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, SMALL).select("doc_id", "text").collect()]
    want = [(d, n, k, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, n, k in brute_lines(rows)]
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_collocations", "op13_line_dedup"])
def test_query_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    relation = con.sql(queries.ORACLE[name]).project(", ".join(got.columns))
    assert sorted(map(tuple, got.collect())) == sorted(relation.fetchall())
