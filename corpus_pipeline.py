"""Training-corpus pipeline: language ID, quality rules, near-dedup, mixing and packing, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelake.llm import langid, minhash_dedup, mixing, packing, quality
from cyclelake.llm.common import stored
from cyclelake.llm.queries import documents, tokenizer_file


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents without a letter, or whose language the model can't tell, go."""
    return langid.keep(docs, langid.train(docs, ~langid.held_out()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that fail the base rule or a certified cutoff of their language go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the document of least id stays of each group of near duplicates."""
    return minhash_dedup.keep(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the mixture, a row per copy taken, in the order of the curriculum."""
    return mixing.schedule(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 over every document copy."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), "word", end_id=2)


STAGES = [("language ID", language_stage), ("quality rules", quality_stage), ("near-dedup", dedup_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

# Learned models, connected components and tokenizing have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each one's result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
