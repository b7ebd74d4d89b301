"""Cross-sections: features, percentile scores, two-head ranking, pools, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_of(rows: DataFrame, values: list[str], keys: list[str], bins: int = 128) -> dict[str, DataFrame]:
    """For each value column a table (keys, value, below, same, known) of its distinct values: rows of smaller value, of this one, and of any.

    Equal values are counted together and dealt to bins by approximate edges; values are ordered within a bin, and bins, of which a key has at most `bins`,
    within a key. So no task orders a whole column. Nulls count nowhere.
    """
    edges = rows.approxQuantile(values, [k / bins for k in range(1, bins)], 0.25 / bins)
    out = {}
    for name, own in zip(values, edges, strict=True):
        counts = rows.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("same"))
        bounds = F.array(*map(F.lit, sorted(set(own)))).cast("array<double>")
        binned = counts.withColumn("bin", F.size(F.filter(bounds, lambda e: e < F.col(name))))
        sizes = binned.groupBy(*keys, "bin").agg(F.sum("same").alias("n"))
        by = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
        before = sizes.select(*keys, "bin", (F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(by).alias("known"))
        upto = F.sum("same").over(Window.partitionBy(*keys, "bin").orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
        # The bins' table is of a fixed size for each key, and keys are few where cross-sections are large.
        out[name] = binned.withColumn("upto", upto).join(before, [*keys, "bin"]).select(*keys, name, (F.col("before") + F.col("upto") - F.col("same")).alias("below"), "same", "known")
    return out


def percentile_scores(items: DataFrame, components: dict[str, list[str]], *partition: str) -> DataFrame:
    """For each component the mean of its features' mid-ranks times 100, nulls left out; null if all are null."""
    names = sorted({f for fs in components.values() for f in fs})
    out = items
    for f, table in spread_of(items, names, list(partition)).items():
        rank = ((F.col("below") + 0.5 * F.col("same")) / F.col("known")).alias(f"__p_{f}")
        out = out.join(table.select(*partition, f, rank), [*partition, f], "left")
    for name, fs in components.items():
        known = F.filter(F.array(*[F.col(f"__p_{f}") for f in fs]), lambda x: x.isNotNull())
        out = out.withColumn(name, F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known) * 100))
    return out.select(*items.columns, *components)


def average_ranks(items: DataFrame, value: str, name: str, *partition: str) -> DataFrame:
    """Adds the rank from 1, smallest first; ties share the mean of their places, nulls have none."""
    table = spread_of(items, [value], list(partition))[value]
    return items.join(table.select(*partition, value, (F.col("below") + (F.col("same") + 1) / 2.0).alias(name)), [*partition, value], "left").select(*items.columns, name)


def two_head_rank(items: DataFrame, heads: dict[str, str], partition: list[str], id_column: str) -> DataFrame:
    """rank_<head> within the partition by score, highest first, ties by id; null scores have no rank. Only ties are ordered together."""
    out = items
    for head, table in zip(heads, spread_of(items, list(heads.values()), partition).values(), strict=True):
        score = heads[head]
        above = (F.col("known") - F.col("below") - F.col("same")).alias("__above")
        out = out.join(table.select(*partition, score, above), [*partition, score], "left")
        tie = F.row_number().over(Window.partitionBy(*partition, score).orderBy(id_column))
        out = out.withColumn(f"rank_{head}", F.when(F.col(score).isNotNull(), F.col("__above") + tie).cast("long")).drop("__above")
    return out.select(*items.columns, *[f"rank_{h}" for h in heads])


def terciles(items: DataFrame, column: str, *partition: str) -> DataFrame:
    """Cut points by place: the values at a third and two thirds of the sorted values; exact, from counts of values rather than an order of rows."""
    t = spread_of(items, [column], list(partition))[column]
    at = lambda k: F.max(F.when((F.col("below") <= F.floor(k * F.col("known") / 3)) & (F.floor(k * F.col("known") / 3) < F.col("below") + F.col("same")), F.col(column)))
    return t.groupBy(*partition).agg(F.max("known").alias("n"), at(1).alias("low"), at(2).alias("high"))


def stratified(items: DataFrame, strata: list[str], id_column: str, n: int, seed: str) -> DataFrame:
    """n items, one of each stratum in turn, by the hash of id and seed instead of chance."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_column).cast("string")), 256)
    s = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in strata]), 256)
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(h))
    return items.withColumn("__h", h).withColumn("__s", s).withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", "__s", "__h").limit(n).drop("__h", "__s")


def pool(members: DataFrame, topic: str, member: str, value: str, active: Column) -> DataFrame:
    """Coverage, breadth with bounds for the unobserved, the leader, and the breadth without it, of each topic's members."""
    m = members.withColumn("__a", F.when(F.col(value).isNotNull(), active))
    g = m.groupBy(topic).agg(
        F.count(F.lit(1)).alias("members"), F.count(value).alias("observed"), F.count_if("__a").alias("active"), F.max_by(member, F.struct(value, F.negate(F.col(member)))).alias("leader"), F.max_by("__a", F.struct(value, F.negate(F.col(member)))).alias("__lead")
    )
    share = lambda a, b: F.when(b > 0, a.cast("double") / b)
    return g.select(
        topic,
        "members",
        "observed",
        "active",
        share(F.col("observed"), F.col("members")).alias("coverage"),
        share(F.col("active"), F.col("observed")).alias("breadth"),
        share(F.col("active"), F.col("members")).alias("lower"),
        share(F.col("active") + F.col("members") - F.col("observed"), F.col("members")).alias("upper"),
        "leader",
        share(F.col("active") - F.when(F.col("__lead"), 1).otherwise(0), F.col("observed") - 1).alias("without_leader"),
    )


def leave_one_out(rows: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """The mean of the others of a row's key: (sum - own) / (n - 1), with `least` others at least."""
    w = Window.partitionBy(key)
    n = F.count(value).over(w) - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    total = F.sum(value).over(w) - F.coalesce(F.col(value), F.lit(0))
    return rows.withColumn("peers", n).withColumn("peer_mean", F.when(F.col("peers") >= least, total.cast("double") / F.col("peers")))


#: What is asked of evidence before it counts as confirmed, and of news before they count as negative.
THRESHOLDS = {"persistence": 2, "families": 2, "new_observations": 1, "negative": 2, "negative_share": 0.3}


def stages(evidence: DataFrame, information: DataFrame, key: str, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(key, stage, band): the first rule that holds, of fifteen outcomes, from an object's evidence and its news.

    evidence: rows (key, family, usable, stale, high, rising, long_history, persistence, velocity, entered, jumped, observations); only usable rows that
    aren't stale say how attention moves. information: a row a key of all objects (key, negative, negative_share, material, flagged).
    """
    t = thresholds
    live = F.col("usable") & ~F.col("stale")
    strict = live & F.col("high") & F.col("long_history") & (F.col("persistence") >= t["persistence"])
    speed = F.coalesce("velocity", F.lit(0.0))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    facts = evidence.groupBy(key).agg(
        F.count_distinct(F.when(strict, F.col("family"))).alias("confirming"),
        (some(strict & (F.col("velocity") < 0)) & ~some(strict & (F.col("velocity") >= 0))).alias("confirming_slows"),
        some(strict & F.col("rising")).alias("confirming_rises"),
        some(live & F.col("entered") & (F.col("jumped") | (F.col("observations") >= t["new_observations"]))).alias("fresh"),
        some(live & F.col("rising")).alias("rises"),
        some(live & F.col("high")).alias("is_high"),
        some(live & F.col("high") & (speed >= 0)).alias("high_holds"),
        some(live & (speed < 0)).alias("slows"),
        some(live).alias("is_live"),
        some(live & F.col("long_history")).alias("known"),
        F.count(F.lit(1)).alias("rows"),
    )
    confirmed = F.col("confirming") >= t["families"]
    rules = [
        ("negative_attention", "risk", (F.col("negative") >= t["negative"]) & (F.coalesce("negative_share", F.lit(0.0)) >= t["negative_share"])),
        ("risk_excluded", "risk", F.col("flagged")),
        ("decelerating", "monitor", confirmed & F.col("confirming_slows")),
        ("accelerating", "confirmed", confirmed & F.col("confirming_rises")),
        ("high_heat", "confirmed", confirmed),
        ("newborn", "discovery", F.col("fresh")),
        ("warming", "discovery", F.col("rises")),
        ("decelerating", "monitor", F.col("is_high") & ~F.col("high_holds")),
        ("high_heat", "monitor", F.col("is_high")),
        ("information_new", "monitor", F.col("material")),
        ("fading", "monitor", F.col("slows")),
        ("stale", "insufficient", ~F.col("is_live") & (F.col("rows") > 0)),
        ("insufficient", "insufficient", ~F.col("is_live")),
        ("cold_start", "insufficient", ~F.col("known")),
    ]
    flat = information.join(facts, key, "left").na.fill({"rows": 0, "confirming": 0})
    flat = flat.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("confirming_slows", "confirming_rises", "fresh", "rises", "is_high", "high_holds", "slows", "is_live", "known", "flagged", "material")})
    stage, band = F.lit("stable"), F.lit("monitor")
    for name, of, holds in reversed(rules):
        held = F.coalesce(holds, F.lit(False))
        stage, band = F.when(held, name).otherwise(stage), F.when(held, of).otherwise(band)
    return flat.select(key, stage.alias("stage"), band.alias("band"))
