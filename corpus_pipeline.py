"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import on_workers
from tidemark.llm import bpe, decontaminate, jaccard_join, quality, secrets
from tidemark.llm.queries import TOKENIZER
from tidemark.llm.store import lean, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return lean(on_workers(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars anew, after a stage that changes texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker rejects go."""
    return quality.kept(docs, _table(spark, sf_dir, "labels"))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    lean(on_workers(spark))
    return jaccard_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut out; documents that hold too much of them go."""
    return _recounted(decontaminate.cleaned(docs, _table(spark, sf_dir, "benchmark")))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _recounted(secrets.redacted(docs))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digest, and that of the text decoded from them."""
    lean(on_workers(spark))
    return bpe.round_trip(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_dedup", jaccard_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_redaction", secret_redaction),
    ("bpe_encoding", bpe_encoding),
]

#: Neither a fitted model nor a tokenizer can be written in SQL; tests/llm compares the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
