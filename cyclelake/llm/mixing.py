"""Operator 7, mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the corpus's words by weight; a
source's target stops at ``repeat`` times its size and the excess is shared again. That is a water level: sources
sorted by cap / weight are capped from the front until the level for the others lies below the next one's ratio, so
window sums over the table of sources give it at once.

Curriculum: each source's rate over training time is a piecewise-linear schedule. Its integral is the share of the
source's demand spent up to a time; inverting it gives the time at which a given word of the source is due. The
documents of a source stand in a hashed order, repeated ``repeat`` times; each copy covers a stretch of the source's
words, is taken as far as the target reaches, and is due at the middle of its stretch. ``schedule`` range-sorts
copies by that time.

Running sums inside a source go by blocks in proportion to its rows, so a hot source is spread like the rest. The
table of sources has one row per source name and is attached by broadcast only if Spark finds it small.

Defined results: a null or empty text has no words and is taken 0 times; a null source is a source; equal ids and
rows are separate documents (ties in the order are broken by a hash of text and source); without any word all targets are 0; an empty
table gives an empty table; other columns are not read, except that ``schedule`` passes whole rows on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, word_count, words
from .ordering import BLOCKS, running_sum, unit

REPEAT = 3
# Rates at equally spaced times from start to end of training, by weight: light sources fade, heavy ones grow.
SCHEDULES = {1: [1.5, 1.0, 0.5], 2: [1.0, 1.0, 1.0], 3: [0.5, 1.0, 1.5]}


def targets(sized: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """Per source (column ``_source``): source_size, its documents, weight and target."""
    sums = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    sums = stored(sums, "mix-sources")
    place = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last()))
    table = sums.withColumn("weight", ((place - 1) % 3 + 1).cast("int"))
    cap = F.col("source_size").cast("double") * repeat
    front = W.orderBy(F.col("_ratio"), F.col("_source")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    table = table.withColumns({"_ratio": cap / F.col("weight"), "_docs_all": F.sum("_docs").over(everything)})
    table = table.withColumns({
        "_words": F.sum("source_size").over(everything).cast("double"),
        "_capped": F.coalesce(F.sum(cap).over(front), F.lit(0.0)),  # what the sources ahead take if they are capped
        "_heavier": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(front), F.lit(0))})
    level = (F.col("_words") - F.col("_capped")) / F.col("_heavier")
    # the first source whose ratio reaches the level ends the capped ones
    table = table.withColumn("_level", F.min(F.when(F.col("_ratio") >= level, F.struct(F.col("_ratio"), level.alias("l"))))
                             .over(everything)["l"])
    return table.withColumn("target", F.least(cap, F.col("weight") * F.col("_level"))).select(
        "_source", "source_size", "weight", "target", "_docs", "_docs_all")


def due(share: Column, rates: list[float]) -> Column:
    """The time in [0, 1] at which ``share`` of the demand is spent under piecewise-linear ``rates``."""
    parts = len(rates) - 1
    whole = sum((a + b) / 2 for a, b in zip(rates, rates[1:]))
    out, spent = F.lit(1.0), [0.0]
    for a, b in zip(rates, rates[1:]):
        spent.append(spent[-1] + (a + b) / 2 / whole)
    for i in reversed(range(parts)):
        a, b = rates[i], rates[i + 1]
        rest = (share - spent[i]) * whole  # = a t + (b - a) t^2 / 2 inside this stretch
        t = rest / a if a == b else (F.sqrt(F.greatest(F.lit(a * a) + rest * (2 * (b - a)), F.lit(0.0))) - a) / (b - a)
        out = F.when(share < spent[i + 1], (t + i) / parts).otherwise(out)
    return out


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         repeat: int = REPEAT, tie: bool = False) -> DataFrame:
    """Per row: id, size, source_size, target, taken, and ``copies`` (copy, words taken, due time) of those taken.

    Texts are read once and never moved; ``tie`` adds the hash of text and source as ``_tie``.
    """
    text = F.col(text_col).cast("string")
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("_source"),
                      word_count(text).alias("size"), F.xxhash64(F.col(id_col), F.lit("order")).alias("_order"),
                      F.xxhash64(text, F.col(source_col)).alias("_tie"))
    sized = stored(sized, "mix-sizes")
    sources = stored(targets(sized, repeat), "mix-targets").withColumnRenamed("_source", "_name")
    blocks = F.ceil(F.lit(float(BLOCKS)) * F.col("_docs") / F.col("_docs_all"))
    placed = sized.join(sources, sized["_source"].eqNullSafe(sources["_name"])).drop("_name")
    placed = stored(placed.withColumn("_block", F.floor(unit(F.col("_order")) * blocks).cast("int")), "mix-placed")
    ordered = running_sum(placed, ["_source"], ["_block"], [F.col("_order"), F.col("doc_id"), F.col("_tie"), F.col("size")],
                          {"_start": F.col("size")})
    copies = []
    for copy in range(repeat):
        start = (F.col("_start") + F.col("source_size") * copy).cast("double")
        taken = F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), F.round(F.col("target")) - start))
        share = F.try_divide(start + taken / 2, F.col("target"))
        time = F.coalesce(*[F.when(F.col("weight") == w, due(share, r)) for w, r in SCHEDULES.items()])
        copies.append(F.struct(F.lit(copy).alias("copy"), taken.cast("long").alias("words"), time.alias("due")))
    out = ordered.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    return out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", *(["_tie"] if tie else []))


def schedule(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             **settings) -> DataFrame:
    """The mixture itself: the rows of ``df``, one per copy taken, sorted by due time over the whole table.

    A source's last copy may be cut: its text is then the words taken, with single spaces between them. The plan is
    joined back to the rows by id and hash of text and source (rows equal in both are numbered), so texts are shuffled twice: for
    that join, and for the final order.
    """
    planned = plan(df, id_col, text_col, source_col, tie=True, **settings).where(F.size("copies") > 0)
    same = W.partitionBy("doc_id", "_tie").orderBy("size", "source_size", "taken")
    planned = stored(planned.select(F.col("doc_id").alias("_pid"), F.col("_tie").alias("_ptie"), "size", "source_size", "copies",
                                    F.row_number().over(same).alias("_pnth")), "mix-plan")
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"),
                     F.xxhash64(F.col(text_col).cast("string"), F.col(source_col)).alias("_tie"))
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("_id", "_tie").orderBy(F.xxhash64("_row"))))
    match = [rows[a].eqNullSafe(planned[b]) for a, b in (("_id", "_pid"), ("_tie", "_ptie"), ("_nth", "_pnth"))]
    copies = rows.join(planned, match).select("_row", "size", F.explode("copies").alias("_copy"))
    text = F.col(f"_row.{text_col}")
    cut = F.when(F.col("_copy.words") < F.col("size"),
                 F.array_join(F.slice(words(text), 1, F.col("_copy.words").cast("int")), " ")).otherwise(text)
    due_rows = copies.select(F.col("_row").withField(text_col, cut).alias("_row"), F.col("_copy.due").alias("_due"))
    return due_rows.repartitionByRange("_due").sortWithinPartitions("_due").select("_row.*")
