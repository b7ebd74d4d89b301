"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import delete, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours (small: those below it, and itself; else: those above it) to the smallest node seen from it.

    The smallest is found by an aggregate that combines before its shuffle and is
    written before it is joined back. So both sides of the join are plain: Spark
    broadcasts the smallest where their table is small, or splits a hub's
    neighbours; they are never gathered in one place.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.where("v < u") if small else both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "links-least")
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    # Repeats of a large star do no harm; the small star that follows drops them.
    out = written(out.where("a <> b").distinct() if small else out.where("a <> b"), "links", instead_of=edges)
    delete(least)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in a link of `edges` (a, b): the smallest id that can be reached. Ids in no link are left out."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, seen = written(e, "links"), None
    for _ in range(rounds):
        now = e.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if now == seen or not now["n"]:
            break
        seen = now
        e = _star(_star(e, small=False), small=True)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
