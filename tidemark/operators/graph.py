"""Edges: exposure, event paths, co-mentions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an edge's relation and its business stage weigh.
RELATIONS = {"direct_business": 1.0, "industry_transmission": 0.55, "narrative": 0.0}
STAGES = {"mass_production": 1.0, "pilot": 0.5, "research": 0.25}


def _weight(column: str, table: dict[str, float], default: float | None) -> Column:
    out = F.lit(default).cast("double")
    for k, v in table.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def exposure(edges: DataFrame) -> DataFrame:
    """Adds structural (relation times stage, a half where unknown) and measured (relation times share; null where the share is unknown); both null without evidence."""
    relation, stage = _weight("relation", RELATIONS, 0.0), _weight("stage", STAGES, 0.5)
    there = F.col("evidence").isNotNull()
    return edges.withColumn("structural", F.when(there, relation * stage)).withColumn("measured", F.when(there, relation * F.col("share")))


def paths(edges: DataFrame, events: DataFrame, topic: str) -> DataFrame:
    """Events of a topic carried to its members, signed by direction, strongest first within a member."""
    return edges.join(events, topic).withColumn("impact", F.coalesce("measured", "structural") * F.col("direction") * F.col("importance"))


def comentions(rows: DataFrame, fact: list[str], family: str, member: str, most: int | None) -> DataFrame:
    """(a, b, n, families): members that one record names, with a < b: in how many facts, and by how many families.

    A record is a fact in one family's words. Of its members, in order, the first
    `most` make pairs, as a report that lists everything says little about two of
    them; None: all of them do.
    """
    record = [*fact, family]
    r = rows.select(*record, member).distinct()
    if most is not None:
        r = r.withColumn("place", F.row_number().over(Window.partitionBy(*record).orderBy(member))).where(F.col("place") <= most).drop("place")
    pairs = r.select(*record, F.col(member).alias("a")).join(r.select(*record, F.col(member).alias("b")), record).where("a < b")
    # A pair's facts and families are few beside its records: each is counted once before they are put together.
    once = pairs.groupBy("a", "b", *fact).agg(F.collect_set(family).alias("families"))
    return once.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set("families")))).cast("long").alias("families"))


def strongest_pairs(rows: DataFrame, fact: list[str], member: str, k: int, keep: Callable[[DataFrame], DataFrame], first: int = 64) -> tuple[DataFrame, int]:
    """((a, b, n) of the k pairs that share most facts, a < b, ties by a, then b; the number of pair rows that were made for it).

    A pair shares no more facts than its rarer member has. Members are taken by falling support, twice as many a round, and only pairs that a new member is
    in are counted; once the next member's support is below the k-th pair's count, no other pair can reach it. All members of a record count,
    however many. `keep` writes a round's rows. The driver holds how many members have each support, not the members.
    """
    r = rows.select(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fact)], F.col(member).alias("m")).where("m is not null").distinct()
    on = [f"f{i}" for i in range(len(fact))]
    support = keep(r.groupBy("m").agg(F.count(F.lit(1)).alias("support")))
    counts = [(x["support"], x["n"]) for x in support.groupBy("support").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("support")).collect()]
    held = keep(r.join(support, "m"))
    best, made, above, least, wanted, taken, kth = None, 0, None, None, first, 0, 0
    while counts and counts[0][0] >= max(kth, 1):
        # Whole levels of support, until enough members are in.
        while counts and taken < wanted and counts[0][0] >= max(kth, 1):
            least, n = counts.pop(0)
            taken += n
        inside = held.where(F.col("support") >= least)
        new = F.lit(True) if above is None else (F.col("sa") < above) | (F.col("sb") < above)
        x, y = (inside.select(*on, F.col("m").alias(c), F.col("support").alias(f"s{c}")) for c in "ab")
        pairs = keep(x.join(y, on).where("a < b").where(new).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
        made += pairs.agg(F.sum("n")).first()[0] or 0
        both = pairs if best is None else best.unionByName(pairs)
        best = keep(both.orderBy(F.desc("n"), "a", "b").limit(k))
        size = best.agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).first()
        kth = size["n"] if size["c"] == k else 0
        above, wanted = least, 2 * taken
    return (best if best is not None else r.select(F.col("m").alias("a"), F.col("m").alias("b"), F.lit(0).cast("long").alias("n")).limit(0)), made


def with_onset_lag(pairs: DataFrame, onsets: DataFrame, member: str, onset: str, minutes: int) -> DataFrame:
    """Adds lag_minutes, from a's onset to b's in units of `minutes`, and first_seen, the one that began; null where one has no onset."""
    side = lambda x: onsets.select(F.col(member).alias(x), F.col(onset).alias(f"{onset}_{x}"))
    lag = F.col(f"{onset}_b") - F.col(f"{onset}_a")
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return out.select(*pairs.columns, (lag * minutes).cast("long").alias("lag_minutes"), F.when(lag >= 0, F.col("a")).when(lag < 0, F.col("b")).alias("first_seen"))
