"""Distinct actors over windows, cohorts, concentration, retention. Unknown stays unknown: a zero needs full coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_actors(rows: DataFrame, keys: list[str], time: str, actor: str, ends: DataFrame, end: str, minutes: tuple[int, ...]) -> DataFrame:
    """Distinct actors in the last m minutes before each end, for each m.

    Each fact is sent to the ends whose longest window holds it by bucket, so the
    join is on equal keys; ends are a table, so many moments are one plan.
    """
    width = max(minutes) * 60_000_000
    e = ends.withColumn("__b", F.explode(F.sequence(F.expr(f"({end} - {width}) div {width}"), F.expr(f"{end} div {width}"))))
    r = rows.withColumn("__b", F.expr(f"{time} div {width}"))
    joined = r.join(e, [*keys, "__b"]).where((F.col(time) >= F.col(end) - width) & (F.col(time) < F.col(end)))
    return joined.groupBy(*keys, end).agg(*[F.countDistinct(F.when(F.col(time) >= F.col(end) - m * 60_000_000, F.col(actor))).alias(f"actors_{m}") for m in minutes])


def sliding_actors(rows: DataFrame, keys: list[str], time: str, actor: str, minutes: tuple[int, ...], step: int = 5, opening: int = 570) -> DataFrame:
    """(keys, end, actors_m): distinct actors in the last m minutes before each end of a grid of `step` minutes, for each m.

    Times are microseconds. A window doesn't reach back beyond the session of its end: a day has one up to minute `opening`, which may end
    there, and one after it. A fact counts its actor at the ends after it up to the actor's next fact, the window's width or the session's last end,
    whichever comes first; so it adds one at the first of these ends and takes one away behind the last, and a
    running sum over the session's ends has the distinct actors. Work is linear in facts, whatever the widths. Ends of
    which the longest window holds nobody have no row.
    """
    unit, day = step * 60_000_000, 86_400_000_000
    facts = rows.select(*keys, F.col(time).alias("t"), F.col(actor).alias("actor")).where("t is not null and actor is not null").distinct()
    start = F.expr(f"t - pmod(t, {day})")
    early = F.expr(f"pmod(t, {day}) < {opening * 60_000_000}")
    facts = facts.withColumns({"open": F.when(early, start).otherwise(start + opening * 60_000_000), "last": F.when(early, start + opening * 60_000_000).otherwise(start + day - unit)})
    facts = facts.withColumn("next", F.lead("t").over(Window.partitionBy(*keys, "actor").orderBy("t")))
    floor = lambda c: c - F.pmod(c, F.lit(unit))
    first = floor(F.col("t")) + unit
    ends = [(m, floor(F.least("next", F.col("t") + m * 60_000_000, "last"))) for m in minutes]
    steps = F.flatten(F.array(*[F.when(end >= first, F.array(F.struct(F.lit(m).alias("m"), first.alias("end"), F.lit(1).alias("by")), F.struct(F.lit(m).alias("m"), (end + unit).alias("end"), F.lit(-1).alias("by")))).otherwise(F.array().cast("array<struct<m:int,end:bigint,by:int>>")) for m, end in ends]))
    changes = facts.select(*keys, "open", "last", F.explode(steps).alias("x")).groupBy(*keys, "open", "last", F.col("x.end").alias("end")).agg(*[F.sum(F.when(F.col("x.m") == m, F.col("x.by")).otherwise(0)).alias(f"by_{m}") for m in minutes])
    session = Window.partitionBy(*keys, "open").orderBy("end")
    held = changes.withColumns({f"actors_{m}": F.sum(f"by_{m}").over(session.rowsBetween(Window.unboundedPreceding, 0)) for m in minutes} | {"until": F.coalesce(F.lead("end").over(session), F.col("last") + unit)})
    held = held.where((F.col(f"actors_{max(minutes)}") > 0) & (F.col("until") > F.col("end")))
    return held.select(*keys, F.explode(F.sequence(F.col("end"), F.col("until") - unit, F.lit(unit))).alias("end"), *[f"actors_{m}" for m in minutes])


def first_seen(rows: DataFrame, keys: list[str], actor: str, time: str) -> DataFrame:
    return rows.groupBy(*keys, actor).agg(F.min(time).alias("first"))


def cohort_of(last_before: Column, at: Column, background_days: Column, unit: int, near: int = 5, least: int = 3) -> Column:
    """continuous (seen within `near` units before), returning (earlier), new_in_sample (never, with enough background), unknown."""
    return (
        F.when(last_before.isNotNull() & (at - last_before <= near * unit), "continuous").when(last_before.isNotNull(), "returning").when(background_days >= least, "new_in_sample").otherwise("unknown")
    )


def concentration(rows: DataFrame, keys: list[str], actor: str) -> DataFrame:
    """hhi of posts by actor, and 1 / hhi, the effective number of actors."""
    c = rows.groupBy(*keys, actor).agg(F.count(F.lit(1)).alias("c"))
    # The sum of squares is of whole numbers, so it is exact in any order.
    s = c.groupBy(*keys).agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.count(F.lit(1)).alias("actors"))
    hhi = F.col("squares").cast("double") / (F.col("total") * F.col("total"))
    return s.select(*keys, "actors", "total", hhi.alias("hhi"), (1.0 / hhi).alias("effective"))


#: Pools of a member up to which all its pairs of pools are counted where the member is.
MOST_POOLS = 1000


def overlap(pools: DataFrame, key: str, member: str, least: float) -> DataFrame:
    """(a, b, both, union, jaccard) for pairs of pools whose Jaccard similarity is `least` or more.

    Pairs of a member's pools are made where the member is and counted before
    the shuffle, so no pair goes about with its members. Members of more than
    MOST_POOLS pools are busy: they stand last in each pool's order, rarest
    first, and bring two pools together only where both have one among their
    first n - ceil(least n) + 1; then they are looked up for pairs that with
    them can still reach `least`.
    """
    p = pools.select(key, member).distinct()
    size = p.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    spread = p.groupBy(member).agg(F.count(F.lit(1)).alias("pools")).where(F.col(member).isNotNull())
    busy = spread.where(F.col("pools") > MOST_POOLS)
    any_busy = bool(busy.limit(1).count())
    sided = lambda df, *more: [df.select(member, F.col(key).alias(x), *[F.col(c).alias(f"{c}{x}") for c in more]) for x in "ab"]
    a, b = sided(p.join(spread.where(F.col("pools") <= MOST_POOLS), member, "left_semi") if any_busy else p)
    both = a.join(b, member).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    if any_busy:
        need = lambda n: F.ceil(n * least - 1e-9)
        held = p.join(busy, member)
        own = Window.partitionBy(key)
        placed = held.join(size, key).withColumns({"held": F.count(F.lit(1)).over(own), "place": F.row_number().over(own.orderBy("pools", member))})
        a, b = sided(placed.where(F.col("n") - F.col("held") + F.col("place") <= F.col("n") - need(F.col("n")) + 1), "n")
        near = a.join(b, member).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= need(F.greatest("na", "nb")))).select("a", "b")
        have = held.groupBy(key).agg(F.count(F.lit(1)).alias("held")).join(size, key)
        a, b = (have.select(F.col(key).alias(x), F.col("n").alias(f"n{x}"), F.col("held").alias(f"held{x}")) for x in "ab")
        reach = F.col("both") + F.least("helda", "heldb")
        open_ = both.join(a, "a").join(b, "b").where(reach >= least * (F.col("na") + F.col("nb") - reach) - 1e-6).select("a", "b")
        a, b = sided(held)
        found = near.unionByName(open_).distinct().join(a, "a").join(b, ["b", member]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
        both = both.unionByName(found).groupBy("a", "b").agg(F.sum("both").alias("both"))
    both = both.join(size.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    union = F.col("na") + F.col("nb") - F.col("both")
    return both.select("a", "b", "both", union.alias("union"), (F.col("both").cast("double") / union).alias("jaccard")).where(F.col("jaccard") >= least)


def retention(rows: DataFrame, keys: list[str], actor: str, day: str, horizon: int, covered: DataFrame) -> DataFrame:
    """(keys, cohort, offset, size, actors): of those first seen on a covered day, how many are back on each of the next days.

    covered: (keys, day) of the days that were observed in full. A cohort of another day is unknown and has no rows; `actors` is null where
    the later day wasn't covered, and 0 where it was and nobody came.
    """
    days = rows.select(*keys, actor, day).distinct()
    days = days.withColumn("cohort", F.min(day).over(Window.partitionBy(*keys, actor)))
    back = days.withColumn("offset", F.col(day) - F.col("cohort")).where(F.col("offset") <= horizon).groupBy(*keys, "cohort", "offset").agg(F.count(F.lit(1)).alias("actors"))
    sizes = back.where("offset = 0").select(*keys, "cohort", F.col("actors").alias("size"))
    known = covered.select(*keys, day).distinct()
    whole = sizes.join(known.withColumnRenamed(day, "cohort"), [*keys, "cohort"]).withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(horizon).cast("long"))))
    seen = whole.join(back, [*keys, "cohort", "offset"], "left").withColumn(day, F.col("cohort") + F.col("offset")).join(known.withColumn("known", F.lit(True)), [*keys, day], "left")
    return seen.select(*keys, "cohort", "offset", "size", F.when(F.col("known"), F.coalesce("actors", F.lit(0))).alias("actors"))
