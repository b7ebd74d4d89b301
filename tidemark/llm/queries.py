"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark import on_workers, spread

from .oracles import SQL as SQL
from .store import lean

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = lean(on_workers(spark)).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name == "documents" else table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.report(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import word_dedup

    return word_dedup.report(_table(spark, sf_dir, "documents"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import nn_descent

    return nn_descent.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.report(_table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.round_trip(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import chat

    said = "<|im_end|><|im_start|>assistant ok"
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.report(table.unionByName(extra))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_count

    return token_count.token_counts(_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import align

    return align.aligned(_table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.report(_table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import negatives

    table = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    noisy = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mined(noisy, F.col("id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_benchmark_decontamination, op3_suffix_array_dedup, op4_secret_scans, op5_substring_dedup, op6_nn_descent, op7_jaccard_join, op8_bpe_round_trip, op9_chat_formatting, op10_token_counts, op11_cross_tokenizer, op12_warc, op13_hard_negatives)}
