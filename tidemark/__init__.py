"""Tidemark: bitemporal attention analytics and training-data operators on Spark."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def on_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it is at the same path; on a cluster without it, ship it with --py-files."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt over all cores for work that is heavy a row; any other as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * (16 << 20) and len(df.inputFiles()) < cores else df
