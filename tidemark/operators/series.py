"""Time-series evidence: same-clock history, change, anomalies, hot runs, onsets.

Every operator works on all points of all series at once; a moment in the past is
a filter on both clocks before it. All windows of one operator share a
partitioning by series, so rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio


def lookbacks(points: DataFrame, series: list[str], order: str, value: str, spans: tuple[int, ...]) -> DataFrame:
    """For each span n: mean_n and n_n of the last n earlier points, and the change against that mean; g_3_20 only with 23 points."""
    w = Window.partitionBy(*series).orderBy(order)
    out = points
    for n in spans:
        before = w.rowsBetween(-n, -1)
        count = F.count(value).over(before)
        mean = F.when(count > 0, F.sum(value).over(before).cast("double") / count)
        out = out.withColumn(f"n_{n}", count).withColumn(f"mean_{n}", mean).withColumn(f"delta_{n}", F.col(value).cast("double") - mean)
    last, prior = w.rowsBetween(-3, -1), w.rowsBetween(-23, -4)
    full = (F.count(value).over(last) == 3) & (F.count(value).over(prior) == 20)
    g = ratio(F.sum(value).over(last).cast("double") / 3.0, F.sum(value).over(prior).cast("double") / 20.0)
    return out.withColumn("g_3_20", F.when(full, g))


def same_clock(points: DataFrame, series: list[str], slot: str, day: str, value: str, sessions: int = 20, least: int = 4) -> DataFrame:
    """Adds n_hist, mean_hist, n_5, q (value over the mean at the same slot of earlier days) and hist_pct (mid-rank in them)."""
    w = Window.partitionBy(*series, slot).orderBy(day)
    past, five = w.rowsBetween(-sessions, -1), w.rowsBetween(-5, -1)
    n = F.count(value).over(past)
    mean = F.when(n > 0, F.sum(value).over(past).cast("double") / n)
    out = points.withColumn("n_hist", n).withColumn("mean_hist", mean).withColumn("n_5", F.count(value).over(five)).withColumn("__past", F.collect_list(value).over(past))
    below = F.size(F.filter("__past", lambda x: x < F.col(value)))
    equal = F.size(F.filter("__past", lambda x: x == F.col(value)))
    pct = F.when(F.col("n_hist") > 0, (below + 0.5 * equal) / F.col("n_hist"))
    q = F.when(F.col("n_hist") >= least, ratio(F.col(value), F.col("mean_hist")))
    return out.withColumn("hist_pct", pct).withColumn("q", q).drop("__past")


def change(points: DataFrame, series: list[str], day: str, tick: str, q: str = "q") -> DataFrame:
    """Adds velocity q - q1 and acceleration q - 2 q1 + q2, where q1 and q2 are one and two ticks back on the same day."""
    w = Window.partitionBy(*series, day).orderBy(tick)
    one, two = F.max(q).over(w.rangeBetween(-1, -1)), F.max(q).over(w.rangeBetween(-2, -2))
    return points.withColumn("q1", one).withColumn("velocity", F.col(q) - one).withColumn("acceleration", F.col(q) - 2 * one + two)


def snapshot_evidence(points: DataFrame, series: list[str], at: int, tick_us: int) -> DataFrame:
    """The latest point of each series with its evidence: history, q, change, percentile, high, rising, accelerating, stale.

    `points` has day, slot (tick of the day), tick, us and value, already cut to what was known at `at`.
    """
    full = change(same_clock(points, series, "slot", "day", "value"), series, "day", "tick")
    names = [c for c in full.columns if c not in series]
    last = full.groupBy(*series).agg(F.max_by(F.struct(*names), "tick").alias("r")).select(*series, "r.*")
    high = F.coalesce(F.col("q") >= 1.5, F.lit(False))
    return last.select(
        *series,
        "us",
        "value",
        "n_hist",
        "q",
        "hist_pct",
        "velocity",
        "acceleration",
        ((F.col("n_hist") >= 16) & (F.col("n_5") >= 4)).alias("history_ok"),
        high.alias("high"),
        (high & F.coalesce(F.col("velocity") > 0, F.lit(False))).alias("rising"),
        F.coalesce(F.col("velocity") >= 0.2, F.lit(False)).alias("accelerating"),
        F.when(high & F.coalesce(F.col("q1") >= 1.5, F.lit(False)), 2).when(high, 1).otherwise(0).alias("persistence"),
        (F.lit(at) - F.col("us") > F.lit(tick_us * 5 // 2)).alias("stale"),
    )


def count_surprise(points: DataFrame, series: list[str], slot: str, day: str, value: str, prior: float = 1.0, sessions: int = 20) -> DataFrame:
    """Shrunken ratio (v + k) / (mu + k), and z against max(mu, variance, 1) (1 + 1/n); null without history."""
    past = Window.partitionBy(*series, slot).orderBy(day).rowsBetween(-sessions, -1)
    n = F.count(value).over(past)
    mu = F.when(n > 0, F.sum(value).over(past).cast("double") / n)
    square = F.sum(F.col(value) * F.col(value)).over(past).cast("double")
    out = points.withColumn("n", n).withColumn("mu", mu).withColumn("__s", square)
    var = F.when(F.col("n") > 1, (F.col("__s") - F.col("n") * F.col("mu") * F.col("mu")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    z = (F.col(value) - F.col("mu")) / F.sqrt(F.greatest(F.col("mu"), var, F.lit(1.0)) * (1 + 1.0 / F.col("n")))
    return out.withColumn("surprise", F.when(F.col("n") > 0, (F.col(value) + prior) / (F.col("mu") + prior))).withColumn("z", F.when(F.col("n") > 0, z)).drop("__s")


def islands(points: DataFrame, series: list[str], order: str, gap: int, hot: Column) -> DataFrame:
    """Numbers the runs of hot points: a run ends where the next hot point is more than `gap` away. Adds run and first_of_series."""
    w = Window.partitionBy(*series).orderBy(order)
    marked = points.withColumn("first_of_series", F.row_number().over(w) == 1).where(hot)
    before = F.lag(order).over(w)
    cut = F.when(before.isNull() | (F.col(order) - before > gap), 1).otherwise(0)
    return marked.withColumn("__cut", cut).withColumn("run", F.sum("__cut").over(w)).drop("__cut")


def excess_area(points: DataFrame, keys: list[str], order: str, value: str, base: float = 1.0) -> DataFrame:
    """Area of value over the base by trapezoids, its peak, and how much of the peak is left at the end."""
    w = Window.partitionBy(*keys).orderBy(order)
    over = F.greatest(F.col(value) - base, F.lit(0.0))
    step = (F.lead(order).over(w) - F.col(order)).cast("double")
    part = (over + F.lead(over).over(w)) / 2.0 * step
    return points.withColumn("__part", part).groupBy(*keys).agg(
        F.min(order).alias("start_us"), F.max(order).alias("end_us"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__part"), F.lit(0.0)).alias("area"), F.max(value).alias("peak"), (F.max_by(value, order) / F.max(value)).alias("retention"), F.max("first_of_series").alias("left_censored")
    )


def first_crossing(points: DataFrame, series: list[str], order: str, value: str, threshold: float, gap: int) -> DataFrame:
    """The first time a series goes from below to at least the threshold between points no more than `gap` apart."""
    w = Window.partitionBy(*series).orderBy(order)
    before, at = F.lag(value).over(w), F.lag(order).over(w)
    up = (before < threshold) & (F.col(value) >= threshold) & (F.col(order) - at <= gap)
    return points.withColumn("__up", up).where("__up").groupBy(*series).agg(F.min(order).alias("onset_us"))


def flows(stock: DataFrame, series: list[str], order: str, value: str, back: int, tolerance: int) -> DataFrame:
    """Stock minus the stock `back` earlier (the last point in the tolerance before that); null where there is none."""
    from .asof import backward_asof

    left = stock.withColumn("then", F.col(order) - back)
    joined = backward_asof(left, stock, series, "then", order, tolerance, [value])
    return joined.withColumn("flow", F.col(value) - F.col(f"asof_{value}")).select(*series, order, value, "flow")
