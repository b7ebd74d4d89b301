"""Column expressions with the engine's null rules: unknown is not zero."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null if either is null or b isn't positive."""
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def number(text: Column) -> Column:
    """A finite double from text with thousands separators and a trailing per cent sign; anything else is null."""
    value = F.regexp_replace(F.trim(text), r",|%$", "").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def mean(x: Column) -> Column:
    """The mean of a decimal column, its sum exact, so that no order of addition shows."""
    return F.sum(x).cast("double") / F.count(x)


def midrank(order: Column, *partition: str) -> Column:
    """(number below + half the number equal) / number, over non-null values of the partition; null for null."""
    whole = Window.partitionBy(*partition)
    below = F.rank().over(whole.orderBy(order.asc_nulls_last())) - 1
    ties = F.count(order).over(Window.partitionBy(*partition, order))
    return F.when(order.isNotNull(), (below + 0.5 * ties) / F.count(order).over(whole))


def average_rank(order: Column, *partition: str) -> Column:
    """Rank from 1; ties share the mean of their places."""
    rank = F.rank().over(Window.partitionBy(*partition).orderBy(order))
    return rank + (F.count(F.lit(1)).over(Window.partitionBy(*partition, order)) - 1) / 2.0


def robust_z(x: Column, median: Column, mad: Column, n: Column, least: int = 4) -> Column:
    """Distance from the median in scaled median deviations; null with too little history or no spread."""
    return F.when((n >= least) & (mad > 1e-9), (x - median) / (1.4826 * mad))


def hhi(counts: Column, total: Column) -> Column:
    """Concentration: the sum of squared shares."""
    return F.sum(F.pow(counts.cast("double") / total.cast("double"), F.lit(2.0)))


def logistic(x: Column, limit: float = 35.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))))


def poisson_deviance(n: Column, expected: Column) -> Column:
    """2 (n ln(n / e) - (n - e))."""
    return 2.0 * (n * F.log(n / expected) - (n - expected))


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear between fixed points, flat outside."""
    out = F.lit(ys[-1])
    for (x0, y0), (x1, y1) in reversed(list(zip(zip(xs, ys, strict=True), list(zip(xs, ys, strict=True))[1:], strict=False))):
        out = F.when(x < x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= xs[0], F.lit(ys[0])).otherwise(out)


def content_hash(*parts: Column) -> Column:
    """32 hex digits that identify the parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def set_hash(column: Column) -> Column:
    """One digest for a group's set of values, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(column.cast("string"))), ","), 256)


def last_by(partition: list[str], *order: Column) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)
