"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, embedding_dedup, hard_negatives, langid, license_scan, line_dedup, minhash_dedup, mixing, oracle,
               packing, quality, sharding, tokencount, tokenfile)
from .common import table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), "word", end_id=2)


@register("op2_embedding_near_dedup", oracle.EMBEDDINGS)
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.98."""
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@register("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near-equal bytes; equal texts stay together."""
    placed = sharding.assign(documents(spark, sf_dir), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return tokencount.count_tokens(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


@register("op5_minhash_near_dedup", oracle.DOCUMENTS)
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a shingle similarity of 0.75."""
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text; learnt without the held-out third."""
    docs = documents(spark, sf_dir)
    predicted = langid.predict(docs, langid.train(docs, ~langid.held_out()))
    return predicted.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@register("op7_source_mixing")
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document, and when its first copy is due."""
    return mixing.plan(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", F.get("copies", F.lit(0))["due"].alias("first_due"))


@register("op8_quality_rules", oracle.QUALITY)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.verdicts(documents(spark, sf_dir), labels).select("doc_id", *quality.BASE, "base_failed", "kept")


@register("op9_token_file")
def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written and read back."""
    path = table_path(spark, "tokens")
    tokenfile.write(documents(spark, sf_dir), path, tokenizer_file("byte_bpe_50k.json"), "byte", end_id=0)
    return tokenfile.documents(spark, path, with_ids=False)


@register("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts and notices found in every whole text."""
    return license_scan.scan(documents(spark, sf_dir))


@register("op11_hard_negatives", oracle.NEGATIVES)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors; every seventh vector's label moves on by one."""
    vec = F.col("vec_id")
    label = F.when(F.pmod(vec, F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec % 100 == 0, label=label)


@register("op12_collocations", oracle.PHRASES)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two or three words."""
    return collocations.collocations(documents(spark, sf_dir))


@register("op13_line_dedup", oracle.LINES)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its lines that later documents hold too."""
    return line_dedup.drop_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
