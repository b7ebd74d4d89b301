"""The lifecycle of objects over runs: episodes that go on, groups, transitions, and pools against the pool before.

A run looks at all objects at one time. What a run says of an object depends on what the run before said of it, and so on back; written out, each step
only asks whether the episode goes on from the one before, so it is a cut between two neighbouring rows and a running count of
cuts. All objects and runs are one plan of windows over (object, time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bands in which an object is followed, and the group of each stage.
ACTIVE = ("discovery", "confirmed")
GROUPS = {"newborn": ("newborn", "early_signal", "emerging"), "sustained": ("high_heat", "accelerating"), "warming": ("warming",), "information": ("information_new",)}


def group_of(band: Column, stage: Column) -> Column:
    """The group that an object is shown in; a band of risk comes before any stage, one without enough data after them."""
    out = F.when(band == "risk", "risk")
    for group, stages in GROUPS.items():
        out = out.when(stage.isin(*stages), group)
    return out.when(band == "insufficient", "insufficient").otherwise("monitor")


def diffusing(rows: DataFrame, observed: Column, members: Column, warm: Column, least_coverage: float = 0.6, least_members: int = 3, least_warm: int = 3, least_breadth: float = 0.3) -> DataFrame:
    """Stage and band overridden where a pool that is known well enough is warm in enough of its members: it spreads. Not where the band is risk."""
    known = (observed / members >= least_coverage) & (observed >= least_members)
    spreads = F.coalesce((F.col("band") != "risk") & known & (warm >= least_warm) & (warm / observed >= least_breadth), F.lit(False))
    return rows.withColumns({"stage": F.when(spreads, "diffusing").otherwise(F.col("stage")), "band": F.when(spreads, "discovery").otherwise(F.col("band")), "spreads": spreads})


def followed(rows: DataFrame, key: str, at: str, evidence: str, gap: int, old_after: int) -> DataFrame:
    """Adds first_detected (the time of the run that began the episode), episode (its number within the object), same_episode, previous_stage,
    transition, and group.

    rows: one a run and object, with band, stage, spreads; times in microseconds. An active object goes on with the episode of its last row if that one was
    active and its evidence is at most `gap` older than this run; else an episode begins here. An object that begins anew and was in an episode more than
    `old_after` ago returns. Rows without evidence end an episode; objects that aren't active have none.
    """
    w = Window.partitionBy(key).orderBy(at)
    active = F.col("band").isin(*ACTIVE)
    rows = rows.withColumns({"active": active, "before": F.lag(F.struct(active.alias("active"), F.col(evidence).alias("evidence"), F.col("stage").alias("stage"))).over(w)})
    goes_on = F.coalesce(F.col("active") & F.col("before.active") & (F.col(at) - F.col("before.evidence") <= gap), F.lit(False))
    rows = rows.withColumn("same_episode", goes_on).withColumn("begins", F.col("active") & ~goes_on)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.min(F.when(F.col("active"), F.col(at))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    returns = F.coalesce(F.col("begins") & (earlier < F.col(at) - old_after), F.lit(False))
    rows = rows.withColumns(
        {
            "first_detected": F.when(F.col("active"), F.last(F.when(F.col("begins"), F.col(at)), ignorenulls=True).over(upto)),
            "episode": F.when(F.col("active"), F.count_if("begins").over(upto)),
            "previous_stage": F.col("before.stage"),
            "transition": ~F.col("before.stage").eqNullSafe(F.col("stage")),
            "group": F.when(F.col("spreads"), "diffusing").when(returns, "returning").otherwise(group_of(F.col("band"), F.col("stage"))),
        }
    )
    return rows.drop("before", "begins", "active")


def pool_changes(rows: DataFrame, key: str, at: str, pool: str, version: str) -> DataFrame:
    """Adds comparable, entered, departed, retained: a pool (an array of distinct members) against that of the object's last run, if both are of one version;
    else the counts are null. A pool is as large as an object's members."""
    w = Window.partitionBy(key).orderBy(at)
    rows = rows.withColumn("old", F.lag(F.struct(F.col(pool).alias("pool"), F.col(version).alias("version"))).over(w))
    rows = rows.withColumn("comparable", F.coalesce(F.col("old.version") == F.col(version), F.lit(False)))
    n = lambda c: F.when(F.col("comparable"), F.size(c).cast("long"))
    return rows.withColumns({"entered": n(F.array_except(pool, "old.pool")), "departed": n(F.array_except("old.pool", pool)), "retained": n(F.array_intersect(pool, "old.pool"))}).drop("old")
