"""Two clocks: what happened when, and what was known when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, at: Column | int, start: int | None = None, end: int | None = None, event: str = "us", known: str = "obs_us") -> DataFrame:
    """Rows known at `at` whose event time is in [start, end). Both are plain filters, so they reach the scan."""
    out = rows.where(F.col(known) <= at)
    if start is not None:
        out = out.where(F.col(event) >= start)
    if end is not None:
        out = out.where(F.col(event) < end)
    return out


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by the order; all columns. An aggregate, so rows are combined before the shuffle."""
    names = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in names])


def effective(edges: DataFrame, at: int, start: str = "effective_from", end: str = "effective_to", revoked: str = "revoked") -> DataFrame:
    """Edges that hold at `at`: [from, to), open where `to` is null, and not revoked."""
    return edges.where((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)) & ~F.col(revoked))


def first_wins(new: DataFrame, stored: DataFrame | None, key: str, *order: str) -> DataFrame:
    """The rows to append: one a key, the first by the order, and none whose key is stored."""
    names = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in names])
    return first if stored is None else first.join(stored.select(key), key, "left_anti")


def vanished(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Members of the snapshot before that the new one hasn't: they get a revoking version."""
    return before.join(now.select(key).distinct(), key, "left_anti")


def changed_versions(rows: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """Versions that differ from the one before them of the same key; the first always counts."""
    w = Window.partitionBy(*keys).orderBy(order)
    state = F.struct(*values)
    return rows.withColumn("__before", F.lag(state).over(w)).where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(state)).drop("__before")


def pruned(rows: DataFrame, kind: Column, event: str, before: int) -> DataFrame:
    """Retention: rows of the kind older than the bound go, all others stay."""
    return rows.where(~(kind & (F.col(event) < before)))
