"""The registered queries and operators on hand-made tables: nulls, empty and long texts, ties, repeats, no rows."""

import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cyclelake.llm import (embedding_dedup, graph, langid, license_scan, minhash_dedup, mixing, oracle, packing, quality,
                           queries, sharding, tokencount, tokenfile)
from cyclelake.llm.common import stored, table_path
from test_local import brute_shingles

SMALL = "/root/testdata/sf0.001"
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SENTENCE = "the quick brown fox jumps over the lazy dog while seven small birds sing in a green tree near my house "
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, "One two three. Released under the MIT License.", "en", "b"),
    (5, SENTENCE * 4, "en", "b"), (6, SENTENCE * 4, "en", "b"), (7, SENTENCE * 4 + "end", "fr", None),
    (7, SENTENCE * 4 + "end", "fr", None), (8, "".join(f"w{i} " for i in range(20000)), "en", "c"),
    (9, "### $$$ 123", None, "c"), (None, "a text without id", "en", "a"), (10, "der hund und die katze " * 30, "de", "a"),
    (11, "der hund und die katze " * 30 + "x", "de", "é"), (12, "x" * 5000, "en", "é"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
# extra columns whose names operators use inside
CLASHES = ["size", "node", "key", "component", "_id", "_row", "_h", "_block", "start", "copies", "due", "stratum", "a", "b"]


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).withColumn("n_chars", F.length("text").cast("long"))


def frame(df):
    return [r.asDict() for r in df.collect()]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_packing_covers_each_row(spark):
    got = frame(packing.pack(table(spark).repartition(3), WORDS, "word", 2, context=256))
    own = library(WORDS)
    want = [(d, np.array(own.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t, *_ in ROWS]
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in want)
    for doc, ids in want:
        mine = [r for r in got if r["doc_id"] == doc]
        times = sum(1 for d, _ in want if d == doc)
        assert sum(r["length"] for r in mine) == times * len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in mine)
    windows = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == windows.get(r["sequence_id"], 0)
        windows[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n & (n - 1) == 0 and n <= 256 for n in windows.values())
    assert frame(packing.pack(table(spark, []), WORDS, "word", 2)) == []


def test_token_files_round_trip(spark):
    path = table_path(spark, "test")
    tokenfile.write(table(spark).repartition(4), path, BYTE, "byte", 0, segment_ids=500)
    got = sorted(frame(tokenfile.documents(spark, path)), key=lambda r: r["start"])
    own, at = library(BYTE), 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for row, (doc, text, *_) in zip(got, order, strict=True):
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (doc, at, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = table_path(spark, "test")
    tokenfile.write(table(spark, []), empty, BYTE, "byte", 0)
    assert frame(tokenfile.documents(spark, empty)) == []


def test_token_counts(spark):
    got, own = frame(tokencount.count_tokens(table(spark), BYTE, limit=100)), library(BYTE)
    assert len(got) == len(ROWS)
    for row, (doc, text, *_) in zip(got, ROWS):
        n = len(own.encode(text or "", add_special_tokens=False).ids)
        assert row == {"doc_id": doc, "n_bytes": len((text or "").encode()), "n_tokens": n, "over_limit": n > 100}
    assert frame(tokencount.count_tokens(table(spark, []), BYTE)) == []


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > middle:
                used, held = used + 1, 0
            held += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards,fan,gather", [(1, 3, 0), (4, 1, 0), (5, 255, 100), (5, 7, 0), (40, 7, 4)])
def test_shards_are_minimax(spark, shards, fan, gather):
    df = table(spark)
    got = frame(sharding.assign(df, shards, fan=fan, gather=gather))
    groups = df.groupBy(F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")).agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("s")).collect()
    loads = {}
    for r in got:
        loads.setdefault(r["shard"], []).append(r)
    assert max(sum(r["size"] for r in x) for x in loads.values()) == least_capacity(
        [r["s"] for r in sorted(groups, key=lambda r: r["h"])], shards)
    for x in loads.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    home = {}
    for r in got:
        assert home.setdefault(r["text_crc32"], r["shard"]) == r["shard"] or r["text_crc32"] == 0
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t, *_ in ROWS)


def test_shards_of_nothing(spark):
    assert frame(sharding.assign(table(spark, []))) == []


def test_hot_group_is_numbered_in_parts(spark):
    rows = [(i, "hot" if i % 2 else f"t{i}", "en", "a") for i in range(600)]
    got = frame(sharding.assign(table(spark, rows), 3))
    assert len({r["shard"] for r in got if r["doc_id"] % 2}) == 1
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def water_level(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight, capped, total = {n: i % 3 + 1 for i, n in enumerate(names)}, set(), sum(sizes.values())
    while True:
        free = [n for n in names if n not in capped]
        left = total - sum(3 * sizes[n] for n in capped)
        target = {n: 3.0 * sizes[n] if n in capped else left * weight[n] / sum(weight[m] for m in free) for n in names}
        over = {n for n in free if target[n] > 3 * sizes[n] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mixture_meets_targets(spark):
    rows = ROWS + [(100 + i, f"few words {i}", "en", f"s{i % 4}") for i in range(40)]
    got = frame(mixing.plan(table(spark, rows)))
    source = {}
    for doc, text, _, name in rows:
        source.setdefault(name, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
    targets = water_level({n: sum(x) for n, x in source.items()})
    assert sorted(r["size"] for r in got) == sorted(n for x in source.values() for n in x)
    by_size = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by_size.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
        assert all(0 <= c["due"] <= 1 for c in r["copies"])
    assert set(by_size) == {(sum(source[n]), round(t, 6)) for n, t in targets.items()}
    assert abs(sum(r["taken"] for r in got) - sum(targets.values())) < len(targets)
    assert frame(mixing.plan(table(spark, []))) == []
    none = frame(mixing.plan(table(spark, [(1, None, "en", "a"), (2, " ", "en", None)])))
    assert [r["taken"] for r in none] == [0, 0]


def test_due_time_inverts_the_integral(spark):
    rates = [0.5, 2.0, 2.0, 0.0, 1.0]
    whole = sum((a + b) / 2 for a, b in zip(rates, rates[1:]))

    def spent(t):
        x, out = t * 4, 0.0
        for i in range(4):
            d = min(max(x - i, 0), 1)
            out += rates[i] * d + (rates[i + 1] - rates[i]) * d * d / 2
        return out / whole

    shares = [i / 50 for i in range(50)]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.due(F.col("s"), rates).alias("t")).collect()
    assert all(abs(spent(r["t"]) - r["s"]) < 1e-9 for r in got)


def test_schedule_repeats_and_cuts(spark):
    df = table(spark, ROWS + [(50 + i, f"w{i} a b c", "en", "zz") for i in range(30)])
    taken = {}
    for r in frame(mixing.plan(df)):
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    rows = frame(mixing.schedule(df))
    words = {}
    for r in rows:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert words == {d: n for d, n in taken.items() if n}
    assert set(rows[0]) == set(df.columns) and rows[0]["size"] == "clash"


def base_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered, lines, dup = {}, set(), set(), 0
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        seen.setdefault(w, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_base_counts_and_labels(spark):
    rows = ROWS + [(60, "a b c a b c\na b c a b c\n\nx\nx\nx |", "en", "a"), (61, "a a a a a", "en", "a"), (62, "a b a b", "en", "a")]
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, None, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = frame(quality.verdicts(table(spark, rows), labels))
    want = sorted(base_of(t) for _, t, *_ in rows)
    assert sorted(tuple(r[c] for c in quality.BASE) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert r["kept"] == (not r["base_failed"])  # too few labels to certify a cutoff
    kept = frame(quality.keep(table(spark, rows), labels.limit(0)))
    assert len(kept) == sum(r["kept"] for r in got) and set(kept[0]) == set(table(spark).columns)
    assert frame(quality.verdicts(table(spark, []), labels)) == []


def test_binomial_tail_is_exact(spark):
    import math

    def tail(k, n, p):
        return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))

    rows = [(k, n, p) for n in (1, 10, 500, 900) for p in (0.005, 0.02, 0.3) for k in (0, 1, 3, n // 5) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long, p double").withColumn(
        "t", quality.binomial_tail(F.col("k"), F.col("n"), F.col("p"))).collect()
    assert all(abs(r["t"] - tail(r["k"], r["n"], r["p"])) < 1e-9 for r in got if r["k"] < (r["n"] + 1) * r["p"])
    cut = quality.binomial_tail(F.col("k"), F.col("n"), F.col("p"), terms=2)  # the rest is bounded from above
    short = spark.createDataFrame([(100, 900, 0.3)], "k long, n long, p double").select(cut.alias("t")).first()["t"]
    assert tail(100, 900, 0.3) <= short < 3 * tail(100, 900, 0.3)


def test_certified_cutoffs_limit_the_loss(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(4000):  # one good text in two hundred has symbols, most bad ones do
        good = i % 4 > 0
        mark = rng.random() < (0.002 if good else 0.9)
        rows.append((i, " ".join(f"w{rng.integers(0, 10 ** 9)}" + ("###" if mark else "") for _ in range(55)), "en", "a"))
        labels.append((i, int(good), 0))
    marked = table(spark, rows)
    seen = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    limits = frame(quality.thresholds(stored(quality.measure(marked), "t"), seen, risk=0.04))
    assert len(limits) == 1 and limits[0]["cut_symbols"] is not None
    got = {r["doc_id"]: r["kept"] for r in frame(quality.verdicts(marked, seen, risk=0.04))}
    assert np.mean([not got[i] for i, q, _ in labels if q]) <= 0.04
    assert np.mean([not got[i] for i, q, _ in labels if not q]) > 0.8
    assert frame(quality.thresholds(stored(quality.measure(marked), "t"), seen.where("doc_id < 40"))) == []


def test_joint_cutoffs_need_few_labels(spark):
    rows, labels = [], []
    for i in range(1800):  # good texts repeat words now and then, bad ones have symbols; a few texts have no label
        lang = ("en", "fr", None)[i % 3]
        bad, odd = i % 12 > 8, i % 60 == 0
        text = " ".join(f"w{i}x{j}" + ("###" if bad else "") for j in range(55)) + " one two three one two three" * odd
        rows.append((i, text if i % 36 else "short text", lang, "a"))
        labels.append((i, None if i % 12 == 4 or i % 24 == 11 else int(not bad), 0))
    marked, seen = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    measured = stored(quality.measure(marked), "t")
    limits = {r["stratum"]: r for r in frame(quality.joint_thresholds(measured, seen))}
    assert {s: r["cut_symbols"] is not None for s, r in limits.items()} == {"en": True, "fr": True, None: True}
    assert frame(quality.thresholds(measured, seen)) == []  # rule by rule the same labels certify nothing
    kept = {r["doc_id"] for r in frame(quality.keep(marked, seen))}
    assert kept == {i for i, text, *_ in rows if "###" not in text and text != "short text"}
    judged = {r["doc_id"]: r["kept"] for r in frame(quality.verdicts(marked, seen))}
    assert {i for i, k in judged.items() if k} == kept  # the query and the pipeline's stage judge alike
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows]}))
    con.register("labels", pa.table({"doc_id": [x[0] for x in labels], "quality": pa.array([x[1] for x in labels], pa.int32())}))
    names = con.sql(oracle.QUALITY).columns
    told = {r[names.index("doc_id")]: r[names.index("kept")] for r in con.sql(oracle.QUALITY).fetchall()}
    assert told == judged
    few = seen.where("doc_id < 600")
    assert frame(quality.joint_thresholds(measured, few)) == [] and len(frame(quality.keep(marked, few))) > len(kept)
    wrong = seen.withColumn("quality", F.lit(1))  # cutoffs that would lose good texts aren't certified
    assert frame(quality.joint_thresholds(measured, wrong)) == []


def test_language_of_edge_rows(spark):
    docs = queries.documents(spark, SMALL)
    model = langid.train(docs, ~langid.held_out())
    got = frame(langid.predict(table(spark), model))
    assert len(got) == len(ROWS)
    for r, (doc, text, *_) in zip(got, ROWS):
        assert r["doc_id"] == doc
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text or ""))
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["rejected"])
    kept = frame(langid.keep(table(spark), model))
    assert len(kept) == sum(not r["rejected"] for r in got) and kept[0]["size"] == "clash"
    assert frame(langid.predict(table(spark, []), model)) == []
    untrained = langid.train(table(spark).withColumn("lang", F.lit(None).cast("string")))
    assert untrained is None and {r["lang_pred"] for r in frame(langid.predict(table(spark), None))} == {"und"}


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op6_language_id"](spark, sf).join(queries.documents(spark, sf).select("doc_id", "lang"), "doc_id")
    held = [r for r in got.collect() if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert np.mean([r["rejected"] for r in held]) < 0.01
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)


def reachable(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(7, i) for i in range(30)],
                                   [(5, 9), (9, 5), (2, 2), (9, 1), (20, 21), (22, 21)]])
def test_components(spark, links):
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got} == reachable(nodes, [x for x in links if x[0] != x[1]])
    assert len(got) == len(nodes)


def near_rows():
    rng = np.random.default_rng(8)
    rows, n = list(ROWS), 1000
    for size, edits in ((40, 3), (12, 8), (30, 14)):
        base = [f"v{rng.integers(0, 10 ** 6)}" for _ in range(150)]
        for _ in range(size):
            words = list(base)
            for _ in range(edits):
                words[rng.integers(0, 150)] = f"u{rng.integers(0, 10 ** 6)}"
            rows.append((n, " ".join(words), "en", "a"))
            n += 1
    return rows


def test_near_duplicate_documents(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)  # many block pairs
    rows = near_rows()
    got = frame(minhash_dedup.near_duplicates(table(spark, rows)))
    sets = [(d, brute_shingles(t)) for d, t, *_ in rows]
    linked = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i]
              if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    want = reachable({d for d, _ in sets if d is not None}, linked)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == r["component_id"])
    assert sorted(r["n_shingles"] for r in got) == sorted(len(s) for _, s in sets)
    kept = frame(minhash_dedup.keep(table(spark, rows)))
    assert sorted(r["doc_id"] or 0 for r in kept) == sorted({*want.values(), 0})
    assert frame(minhash_dedup.near_duplicates(table(spark, []))) == []


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(1, None, 0), (2, [], 0), (3, [0.0] * 8, 0), (4, [1.0, None] * 4, 0), (5, [float("nan")] * 8, 0),
            (6, [1e200] * 8, 1), (7, [1e-200] * 8, 1), (8, [1.0] * 8, None), (9, [1.0] * 8, 1), (9, [-1.0] * 8, 1),
            (None, [1.0] * 8, 1), (10, [1.0] * 4, 1), (11, [-1.0] * 8, 1), (12, [float("inf")] + [1.0] * 7, 1)]
    for label in (2, 3):
        base = rng.standard_normal(8)
        for i in range(70):
            rows.append((100 * label + i, (base + rng.standard_normal(8) * 0.05 * (i % 5)).tolist(), label))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    got = frame(embedding_dedup.near_duplicates(df, block=16))
    good = {}
    for k, (node, v, label) in enumerate(rows):
        if node is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            v = np.array(v) / np.abs(v).max()
            good[k] = (node, v / np.sqrt(v @ v), label)
    links, counts = [], {}
    for i, (a, x, p) in good.items():
        for j, (b, y, q) in good.items():
            if i != j and p == q and len(x) == len(y) and x @ y >= 0.98:
                links.append((a, b))
                counts[i] = counts.get(i, 0) + 1
    want = reachable({n for n, *_ in rows if n is not None}, links)
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == sorted(
        (str(n), counts.get(k, 0), str(want.get(n))) for k, (n, *_) in enumerate(rows))
    assert frame(embedding_dedup.near_duplicates(df.limit(0))) == []


def test_license_scan_rows(spark):
    rows = [*ROWS, (30, "x " * 3000 + license_scan.TEMPLATES["mit"] + " y" * 3000, "en", "a"),
            (31, ("Licensed under CC BY-NC 4.0. " * 50), "en", "a"), (31, "licensed UNDER cc by-nc 4.0", "en", "a")]
    got = frame(license_scan.scan(table(spark, rows)))
    assert sorted((r["doc_id"], r["license_id"]) for r in got) == [
        (4, "mit-notice"), (30, "mit"), *[(31, "cc-by-nc-4.0-notice")] * 51]  # every copy of a text
    repeats = sorted(r["start"] for r in got if r["doc_id"] == 31)
    assert repeats == [0, *range(0, 50 * 29, 29)]
    assert all(r["coverage"] == 1.0 and r["verbatim"] for r in got)
    mit = next(r for r in got if r["doc_id"] == 30)
    assert rows[-3][1][mit["start"]:].startswith("Permission is hereby granted") and mit["start"] == 6000
    assert frame(license_scan.scan(table(spark, []))) == []


def test_license_texts_name_their_own_license(spark):
    filler = "nothing of note here " * 40
    names = list(license_scan.TEMPLATES)
    rows = [(i, filler + license_scan.TEMPLATES[n] + " " + filler, "en", "a") for i, n in enumerate(names)]
    mixed = license_scan.TEMPLATES["bsd-3-clause"] + filler + license_scan.TEMPLATES["mit"] + license_scan.TEMPLATES["mit"]
    got = frame(license_scan.scan(table(spark, [*rows, (99, mixed, "en", "a")])))
    for i, name in enumerate(names):
        own = [r for r in got if r["doc_id"] == i and r["within"] is None]
        assert [(r["license_id"], r["verbatim"]) for r in own] == [(name, True)], name
    assert sorted(r["license_id"] for r in got if r["doc_id"] == 99 and r["within"] is None) == ["bsd-3-clause", "mit", "mit"]
    assert {r["within"] for r in got if r["doc_id"] == 99 and r["license_id"] == "bsd-2-clause"} == {"bsd-3-clause"}


def test_every_operator_and_the_pipeline_are_registered():
    from __spark_entry__ import queries as registered

    names = registered()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark):
    docs = queries.documents(spark, SMALL)
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SMALL), "test-stage")
        counts.append((name, before.count(), docs.count()))
        if name != "packing":
            assert docs.columns == columns
        if name == "quality rules":
            assert docs.where(F.size(F.split(F.trim("text"), r"\s+")) < 50).count() == 0
        if name == "near-dedup":
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert counts[0][2] >= 0.98 * counts[0][1]
    own = library(WORDS)
    packed = frame(docs.groupBy("doc_id").agg(F.sum("length").alias("n")))
    mixed = {}
    for r in before.collect():
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + len(own.encode(r["text"], add_special_tokens=False).ids) + 1
    assert {r["doc_id"]: r["n"] for r in packed} == mixed


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{os.path.join(SMALL, t)}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.sql(queries.ORACLE[name])
    places = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(got.columns) == [want.columns[i] for i in places]
    rows = sorted(map(repr, (tuple(r[i] for i in places) for r in want.fetchall())))
    assert sorted(map(repr, map(tuple, got.select(*sorted(got.columns)).collect()))) == rows
