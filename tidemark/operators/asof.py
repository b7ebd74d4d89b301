"""Joins by nearest time, and cover of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backward_asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, time: str, tolerance: int, values: list[str]) -> DataFrame:
    """For each left row the last right row of its keys with time in [at - tolerance, at]; nulls where there is none.

    Both sides go by key and one time order through a single window, so a hot key
    costs a sort, not a product of its rows.
    """
    tag = left.select("*", F.col(at).alias("__t"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"__v_{v}") for v in [time, *values]])
    add = right.select(*keys, *[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema if f.name not in keys], F.col(time).alias("__t"), F.lit(0).alias("__side"), *[F.col(v).alias(f"__v_{v}") for v in [time, *values]])
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("__side") == 0, F.struct(*[F.col(f"__v_{v}").alias(v) for v in [time, *values]])), ignorenulls=True).over(w)
    both = tag.unionByName(add).withColumn("__seen", seen).where("__side = 1")
    near = F.col(f"__seen.{time}") >= F.col(at) - tolerance
    return both.select(*left.columns, *[F.when(near, F.col(f"__seen.{v}")).alias(f"asof_{v}") for v in [time, *values]])


def forward_asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, time: str, tolerance: int, values: list[str]) -> DataFrame:
    """For each left row the first right row of its keys with time in [at, at + tolerance]; nulls where there is none.

    The time order runs backwards, so the window only ever grows: a frame that
    shrinks from its start would be worked out anew for each row.
    """
    tag = left.select("*", F.col(at).alias("__t"), F.lit(0).alias("__side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"__v_{v}") for v in [time, *values]])
    add = right.select(*keys, *[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema if f.name not in keys], F.col(time).alias("__t"), F.lit(1).alias("__side"), *[F.col(v).alias(f"__v_{v}") for v in [time, *values]])
    w = Window.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("__side") == 1, F.struct(*[F.col(f"__v_{v}").alias(v) for v in [time, *values]])), ignorenulls=True).over(w)
    both = tag.unionByName(add).withColumn("__seen", seen).where("__side = 0")
    near = F.col(f"__seen.{time}") <= F.col(at) + tolerance
    return both.select(*left.columns, *[F.when(near, F.col(f"__seen.{v}")).alias(f"asof_{v}") for v in [time, *values]])


def covers(intervals: DataFrame, keys: list[str], start: str, end: str, lo: str, hi: str) -> DataFrame:
    """(keys, covered): whether each key's intervals, clipped to [lo, hi), leave no gap in it. An empty window is covered."""
    clip = intervals.select(*keys, F.greatest(start, lo).alias("s"), F.least(end, hi).alias("e"), F.col(lo).alias("lo"), F.col(hi).alias("hi")).where("s < e or lo >= hi")
    w = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gaps = clip.withColumn("reach", F.coalesce(F.max("e").over(w), F.col("lo")))
    return gaps.groupBy(*keys).agg(((F.max("lo") >= F.max("hi")) | ((F.max(F.when(F.col("s") > F.col("reach"), 1).otherwise(0)) == 0) & (F.max("e") >= F.max("hi")))).alias("covered"))
