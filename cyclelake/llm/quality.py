"""Operator 8, quality rules with risk-controlled thresholds.

Base counts of every whole text come from native array expressions. Each rule scores a text by a share (higher is
worse) and rejects above a cutoff. Cutoffs are chosen on labelled documents, per stratum and rule:

* false rejections among the n good labelled documents of a stratum are binomial; cutoffs are *certified* when the exact
  (Clopper-Pearson) upper bound of their share is at most ``risk``, that is when P(Binomial(n, ``risk``) <= rejected) is at most
  the stratum's error level;
* the error level ``error`` is split evenly over all strata (Bonferroni); inside a stratum the cutoffs of all rules form one
  nested sequence, tested until the first failure (fixed sequence), which needs no further correction
  (``joint_thresholds``). With probability 1 - ``error`` every stratum then loses at most ``risk`` of its good documents;
* of the certified steps the one with the largest gain is taken: rejected bad documents less ``cost`` times rejected good ones
  (ties: the milder). A stratum without enough labels to certify a cutoff keeps its rules off.

``thresholds`` certifies each rule by itself instead, at ``risk`` and ``error`` split over the rules too, which needs more labels.

Everything is DataFrame code: counting is one partially aggregated pass, so a hot stratum is no burden.

Defined results: a null or empty text has no words and fails the base rule; a null stratum is a stratum; repeated
rows count each; labels that repeat for an id count once, as bad if any says so; null labels are ignored; empty
labels certify nothing; columns besides id, text and stratum are not read (``judge`` passes them through, and an own
column named like a result is replaced).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, stored, words

# Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CUTOFFS = [round(1 - 0.05 * i, 2) for i in range(1, 20)]
RISK, ERROR, COST = 0.02, 0.05, 5.0


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice (windows compared by 64-bit hash)."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3),
                         lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = lambda s: F.sort_array(F.transform(F.filter(
            s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["p"]))
        span = lambda p: F.aggregate(F.transform(
            p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _bind(ordered, lambda s: _bind(twice(s), span)))

    return F.when(n < 4, F.lit(0)).otherwise(_bind(hashes, covered)).cast("long")


def base_counts(text: Column) -> dict[str, Column]:
    """The base counts and ``n_lines``, ``n_capitals`` of a text, all long."""
    text = F.coalesce(text, F.lit(""))
    left = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    out = {
        "_words": _bind(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))),
        "_lines": _bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))),
        "word_chars": left(SPACES),
        "n_symbols": F.length(text) - left(SYMBOLS),
        "n_capitals": F.length(text) - left(CAPITALS),
    }
    return out


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
            keep: str | None = None) -> DataFrame:
    """``df``'s id and stratum (as ``stratum``) with all counts; ``keep`` names a struct column for the whole row."""
    first = df.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"),
                      *([F.struct("*").alias(keep)] if keep else []),
                      *[c.alias(n) for n, c in base_counts(F.col(text_col).cast("string")).items()])
    return first.select("doc_id", "stratum", *([keep] if keep else []), F.col("_words.n").cast("long").alias("n_words"),
                        *[F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_capitals")],
                        (F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines"),
                        F.col("_lines.n").cast("long").alias("n_lines"),
                        F.col("_words.r").cast("long").alias("n_repeat_words"))


def scores() -> dict[str, Column]:
    """The rules' shares, from the counts; 0 where the denominator is."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {"symbols": share("n_symbols", "word_chars"), "capitals": share("n_capitals", "word_chars"),
            "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 10, shifted back (error below 1e-12)."""
    y = x + 10.0
    inverse = F.lit(1.0) / y
    cube = inverse * inverse * inverse
    series = inverse / 12 - cube / 360 + cube * inverse * inverse / 1260 - cube * cube * inverse / 1680
    shift = reduce(lambda a, i: a + F.log(x + float(i)), range(1, 10), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: Column, terms: int = 2000) -> Column:
    """P(Binomial(n, p) <= k): terms from k downwards, what is left out bounded from above; 1 from the mean on."""
    k, n = k.cast("double"), n.cast("double")
    largest = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(p) + (n - k) * F.log(1 - p))
    ratio = lambda i: i / (n - i + 1) * (1 - p) / p
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))
    steps = F.when(k >= 1, F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int") - 1)).otherwise(
        F.array().cast("array<int>"))
    step = lambda a, i: F.struct((a["sum"] + a["term"] * ratio(k - i)).alias("sum"), (a["term"] * ratio(k - i)).alias("term"))  # noqa: E731,E501
    added = F.aggregate(steps, zero, step)
    rest = F.when(k > terms, added["term"] * ratio(k) / (1 - ratio(k))).otherwise(0.0)
    return F.when(k >= (n + 1) * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), largest * (added["sum"] + rest)))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, cost: float = COST,
               cutoffs: list[float] = CUTOFFS) -> DataFrame:
    """One row per stratum with a certified rule: ``stratum`` and the cutoff of each rule (null: off)."""
    rules = scores()
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    counted = measured.select("doc_id", "stratum", *[c.alias(f"_{r}") for r, c in rules.items()]).join(good, "doc_id")
    above = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("place"), F.lit(c).alias("cutoff"),
                      F.count_if(F.col("good") & (F.col(f"_{r}") > c)).alias("lost"),
                      F.count_if(~F.col("good") & (F.col(f"_{r}") > c)).alias("caught"))
             for r in rules for i, c in enumerate(cutoffs)]
    table = counted.groupBy("stratum").agg(F.count_if("good").alias("n"), F.array(*above).alias("tests"))
    table = stored(table, "quality-counts").withColumn("families", F.count(F.lit(1)).over(W.partitionBy()) * len(rules))
    tests = table.select("stratum", "n", "families", F.inline("tests"))
    level = F.lit(error) / F.col("families")
    passed = (F.col("n") > 0) & (binomial_tail(F.col("lost"), F.col("n"), F.lit(risk / len(rules))) <= level)
    sequence = W.partitionBy("stratum", "rule").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    certified = tests.withColumn("ok", F.min(passed.cast("int")).over(sequence)).where("ok = 1")
    gain = F.struct(F.col("caught") - cost * F.col("lost"), -F.col("place"))
    return certified.groupBy("stratum").agg(*[
        F.max_by(F.when(F.col("rule") == r, F.col("cutoff")), F.when(F.col("rule") == r, gain)).alias(f"cut_{r}")
        for r in rules])


def base_rule() -> Column:
    """Whether a text fails the base rule, from the counts."""
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def joint_thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR,
                     cost: float = COST, cutoffs: list[float] = CUTOFFS) -> DataFrame:
    """As ``thresholds``, with the rules of a stratum certified together: what ``verdicts`` and ``keep`` use.

    A stratum's cutoffs form one nested sequence: rule after rule, each from the mildest cutoff to its strictest useful
    one. A step loses the good documents that pass the base rule and that any cutoff so far rejects; it is certified
    when P(Binomial(n, ``risk``) <= lost) <= ``error`` / strata, n being all good labelled documents of the stratum, and
    testing stops at the first failure. So with probability 1 - ``error`` every stratum loses at most ``risk`` of its
    good documents to all cutoffs together. The certified step of the largest gain is taken.

    The order of the rules and their strictest cutoffs come only from documents that aren't labelled good (bad ones,
    and unlabelled ones to estimate the good ones lost), so the tests are independent of that choice. A rule without an
    estimated gain comes last, one that catches no bad document is off. Rows without an id have no label and aren't used here.
    """
    rules, k = list(scores()), len(cutoffs)
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    shares = measured.where("doc_id IS NOT NULL").select(
        "doc_id", "stratum", base_rule().alias("base_failed"), *[c.alias(f"_{r}") for r, c in scores().items()])
    # the first place in ``cutoffs`` that rejects a text; k: none does
    place = {r: reduce(lambda a, b: a + b, [(F.col(f"_{r}") <= c).cast("int") for c in cutoffs]) for r in rules}
    cells = stored(shares.join(good, "doc_id", "left").groupBy(
        "stratum", "good", "base_failed", *[p.alias(r) for r, p in place.items()]).agg(
        F.count(F.lit(1)).alias("rows")), "quality-cells")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))
    bad, unknown = ~F.col("good"), F.col("good").isNull()
    totals = cells.groupBy("stratum").agg(count(F.col("good")).alias("n"), F.try_divide(
        count(~unknown), count(unknown)).alias("scale")).where("n > 0")
    strata = F.broadcast(totals.agg(F.count(F.lit(1)).alias("strata")))
    totals = totals.crossJoin(strata).withColumnRenamed("stratum", "_stratum")
    passing = cells.where(~F.col("base_failed")).join(totals, F.col("stratum").eqNullSafe(F.col("_stratum"))).drop(
        "_stratum")

    mildest_first = W.partitionBy("stratum", "rule").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    caught, others = F.sum("caught").over(mildest_first), F.sum("others").over(mildest_first)
    lost = F.greatest(F.lit(0.0), F.coalesce(others * F.col("scale") - caught, F.lit(0.0)))
    tests = passing.select("*", F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("place")) for r in rules]))).where(F.col("place") < k).groupBy(
        "stratum", "rule", "place", "scale").agg(count(bad).alias("caught"), count(unknown).alias("others")).withColumn(
        "worth", F.struct(F.greatest(F.lit(0.0), caught - cost * lost).alias("hope"), caught.alias("caught"),
                          -F.col("place"))).where("worth.caught > 0")
    useful = tests.groupBy("stratum", "rule").agg(
        F.max_by("place", "worth").alias("last"), F.max("worth").alias("worth")).withColumn(
        "first", k * (F.row_number().over(W.partitionBy("stratum").orderBy(F.desc("worth"), "rule")) - 1))
    plan = useful.groupBy(F.col("stratum").alias("_stratum")).agg(*[
        F.max(F.when(F.col("rule") == r, F.struct("first", "last"))).alias(f"_{r}") for r in rules])

    step = F.least(*[F.when(F.col(r) <= F.col(f"_{r}.last"), F.col(f"_{r}.first") + F.col(r)) for r in rules])
    planned = passing.join(plan, F.col("stratum").eqNullSafe(F.col("_stratum"))).drop("_stratum")
    steps = planned.withColumn("step", step).where("step IS NOT NULL").groupBy(
        "stratum", "n", "strata", "step", *[f"_{r}" for r in rules]).agg(
        count(F.col("good")).alias("lost"), count(bad).alias("caught"))
    so_far = W.partitionBy("stratum").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    sums = steps.withColumns({c: F.sum(c).over(so_far) for c in ("lost", "caught")})
    passed = binomial_tail(F.col("lost"), F.col("n"), F.lit(risk)) <= F.lit(error) / F.col("strata")
    gain = F.col("caught") - cost * F.col("lost")
    taken = sums.withColumn("ok", F.min(passed.cast("int")).over(so_far)).where((F.col("ok") == 1) & (gain > 0)).groupBy(
        "stratum", *[f"_{r}" for r in rules]).agg(F.max_by("step", F.struct(gain, -F.col("step"))).alias("step"))
    at = lambda r: F.least(F.col("step") - F.col(f"_{r}.first"), F.col(f"_{r}.last"))
    cut = F.array(*map(F.lit, cutoffs))
    return taken.select("stratum", *[
        F.when(F.col("step") >= F.col(f"_{r}.first"), F.get(cut, at(r))).alias(f"cut_{r}") for r in rules])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``. ``limits`` is a written table, so Spark knows its size."""
    limits = limits.withColumnRenamed("stratum", "_stratum")
    joined = measured.join(limits, measured["stratum"].eqNullSafe(limits["_stratum"]), "left")
    base = base_rule()
    fine = [F.col(f"cut_{r}").isNull() | (c <= F.col(f"cut_{r}")) for r, c in scores().items()]
    return joined.withColumns({"base_failed": base, "kept": ~base & reduce(lambda a, b: a & b, fine)}).drop(
        "_stratum", *limits.columns)


def verdicts(df: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Per row of ``df``: doc_id, stratum, all counts, base_failed, kept. Texts are read once; counts are written."""
    measured = stored(measure(df), "quality-measured")
    return judge(measured, stored(joint_thresholds(measured, labels, **settings), "quality-limits"))


def keep(df: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``df`` that pass, unchanged (its texts are read twice: to choose cutoffs, and to judge)."""
    limits = stored(joint_thresholds(measure(df), labels, **settings), "quality-limits")
    return judge(measure(df, keep="_row"), limits).where("kept").select("_row.*")
