"""Actors, pools, features, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import set_hash
from tidemark.operators import actors as A
from tidemark.operators import asof, bitemporal, lifecycle, ranking
from tidemark.operators import series as S
from tidemark.sources import files

from . import series as series_plans
from .base import AS_OF, DAY, EV, HOUR, events, registered, table

QUERIES, SQL, query = registered()


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


_MIN = 60_000_000


@query(f"""WITH {EV}, ends AS (SELECT DISTINCT source, (us // {HOUR} + 1) * {HOUR} AS end_us FROM ev)
SELECT e.source, e.end_us, {", ".join(f"count(DISTINCT CASE WHEN ev.us >= e.end_us - {m * _MIN} THEN user_id END) AS actors_{m}" for m in (15, 30, 60))}
FROM ends e JOIN ev ON ev.source = e.source AND ev.us >= e.end_us - {60 * _MIN} AND ev.us < e.end_us GROUP BY 1, 2""")
def rolling_actors(spark: SparkSession, d: str) -> DataFrame:
    """Distinct actors in the last 15, 30 and 60 minutes before each hour's end."""
    e = events(spark, d)
    ends = e.select("source", F.expr(f"(us div {HOUR} + 1) * {HOUR}").alias("end_us")).distinct()
    return A.rolling_actors(e.select("source", "us", "user_id"), ["source"], "us", "user_id", ends, "end_us", (15, 30, 60))


_FIVE, _OPEN = 5 * _MIN, 570 * _MIN


@query(f"""WITH {EV}, w AS (SELECT source, user_id, us, (us // {_FIVE} + k) * {_FIVE} AS end_us FROM ev, range(1, 13) r(k)),
o AS (SELECT *, end_us - end_us % {DAY} + CASE WHEN end_us % {DAY} > {_OPEN} THEN {_OPEN} ELSE 0 END AS open_us FROM w)
SELECT source, end_us, {", ".join(f"count(DISTINCT CASE WHEN us >= end_us - {m * _MIN} THEN user_id END) AS actors_{m}" for m in (15, 30, 60))} FROM o WHERE us >= greatest(end_us - {60 * _MIN}, open_us) GROUP BY 1, 2""")
def sliding_actors(spark: SparkSession, d: str) -> DataFrame:
    """Distinct actors every five minutes in the last 15, 30 and 60 minutes, not beyond the session's open; linear in facts."""
    return A.sliding_actors(events(spark, d), ["source"], "us", "user_id", (15, 30, 60)).withColumnRenamed("end", "end_us")


@query(f"""WITH {EV}, f AS (SELECT source, day, user_id, min(us // {HOUR}) AS tick FROM ev GROUP BY 1, 2, 3), n AS (SELECT source, day, tick, count(*) AS new_actors FROM f GROUP BY 1, 2, 3)
SELECT source, day, tick, new_actors, CAST(sum(new_actors) OVER (PARTITION BY source, day ORDER BY tick) AS BIGINT) AS cumulative FROM n""")
def new_today(spark: SparkSession, d: str) -> DataFrame:
    """Actors first seen today in each hour, and all since the day's start, by first-seen flags."""
    tick = F.expr(f"us div {HOUR}")
    f = A.first_seen(events(spark, d).withColumn("tick", tick), ["source", "day"], "user_id", "tick").withColumnRenamed("first", "tick")
    n = f.groupBy("source", "day", "tick").agg(F.count(F.lit(1)).alias("new_actors"))
    w = Window.partitionBy("source", "day").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("cumulative", F.sum("new_actors").over(w))


@query(f"""WITH {EV}, f AS (SELECT source, user_id, min(day) AS day FROM ev GROUP BY 1, 2), n AS (SELECT source, day, count(*) AS first_time FROM f GROUP BY 1, 2) SELECT source, day, first_time, CAST(sum(first_time) OVER (PARTITION BY source ORDER BY day) AS BIGINT) AS actors FROM n""")
def cumulative_actors(spark: SparkSession, d: str) -> DataFrame:
    """Distinct actors since the start, as a running sum of first-seen flags."""
    f = A.first_seen(events(spark, d), ["source"], "user_id", "day").groupBy("source", F.col("first").alias("day")).agg(F.count(F.lit(1)).alias("first_time"))
    return f.withColumn("actors", F.sum("first_time").over(Window.partitionBy("source").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"""WITH {EV}, a AS (SELECT DISTINCT source, user_id, day FROM ev), l AS (SELECT *, lag(day) OVER (PARTITION BY source, user_id ORDER BY day) AS before, day - min(day) OVER (PARTITION BY source) AS background FROM a)
SELECT source, day, CASE WHEN day - before <= 5 THEN 'continuous' WHEN before IS NOT NULL THEN 'returning' WHEN background >= 3 THEN 'new_in_sample' ELSE 'unknown' END AS cohort, count(*) AS actors FROM l GROUP BY 1, 2, 3""")
def actor_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Actors of a day by when they were seen before."""
    a = events(spark, d).select("source", "user_id", "day").distinct()
    l = a.withColumn("before", F.lag("day").over(Window.partitionBy("source", "user_id").orderBy("day"))).withColumn("background", F.col("day") - F.min("day").over(Window.partitionBy("source")))
    return l.groupBy("source", "day", A.cohort_of(F.col("before"), F.col("day"), F.col("background"), 1).alias("cohort")).agg(F.count(F.lit(1)).alias("actors"))


@query(f"""WITH {EV}, c AS (SELECT source, day, user_id, count(*) AS c FROM ev GROUP BY 1, 2, 3), s AS (SELECT source, day, count(*) AS actors, CAST(sum(c) AS BIGINT) AS total, CAST(sum(c * c) AS DOUBLE) AS sq FROM c GROUP BY 1, 2)
SELECT source, day, actors, total, round(sq / (total * total), 6) AS hhi, round(1.0::DOUBLE / (sq / (total * total)), 6) AS effective FROM s""")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    """Concentration of posts on actors."""
    return A.concentration(events(spark, d), ["source", "day"], "user_id").select("source", "day", "actors", "total", *r6("hhi", "effective"))


_COV = f"""cov AS (SELECT source, day, us // {HOUR} AS tick, (us // {HOUR}) * {HOUR} AS s, (us // {HOUR} + 2) * {HOUR} AS e FROM ev GROUP BY 1, 2, 3, 4, 5)"""


@query(f"""WITH {EV}, {_COV}, w AS (SELECT *, day * {DAY} + {6 * HOUR} AS lo, day * {DAY} + {18 * HOUR} AS hi FROM cov), k AS (SELECT source, day, lo, hi, greatest(s, lo) AS s, least(e, hi) AS e FROM w WHERE greatest(s, lo) < least(e, hi)),
g AS (SELECT *, coalesce(max(e) OVER (PARTITION BY source, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS reach FROM k)
SELECT source, day, max(CASE WHEN s > reach THEN 1 ELSE 0 END) = 0 AND max(e) >= max(hi) AS covered FROM g GROUP BY 1, 2""")
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a source's intervals cover the day's window without a gap."""
    tick = F.expr(f"us div {HOUR}")
    c = events(spark, d).select("source", "day", tick.alias("t")).distinct()
    c = c.select("source", "day", (F.col("t") * HOUR).alias("s0"), ((F.col("t") + 2) * HOUR).alias("e0"), (F.col("day") * DAY + 6 * HOUR).alias("lo"), (F.col("day") * DAY + 18 * HOUR).alias("hi"))
    return asof.covers(c.select("source", "day", F.col("s0").alias("start"), F.col("e0").alias("end"), F.col("lo").alias("from"), F.col("hi").alias("to")), ["source", "day"], "start", "end", "from", "to")


@query(f"""WITH {EV}, k AS (SELECT source, day FROM ev GROUP BY 1, 2 HAVING count(DISTINCT us // {2 * HOUR}) >= 12), d AS (SELECT DISTINCT source, user_id, day FROM ev), c AS (SELECT *, min(day) OVER (PARTITION BY source, user_id) AS cohort FROM d),
b AS (SELECT source, cohort, day - cohort AS "offset", count(*) AS actors FROM c GROUP BY 1, 2, 3), s AS (SELECT source, cohort, actors AS size FROM b WHERE "offset" = 0 AND (source, cohort) IN (SELECT (source, day) FROM k)), w AS (SELECT *, unnest(range(0, 6)) AS "offset" FROM s)
SELECT w.source, w.cohort, w."offset", size, CASE WHEN (w.source, w.cohort + w."offset") IN (SELECT (source, day) FROM k) THEN coalesce(actors, 0) END AS actors FROM w LEFT JOIN b ON b.source = w.source AND b.cohort = w.cohort AND b."offset" = w."offset" """)
def cohort_retention(spark: SparkSession, d: str) -> DataFrame:
    """Who comes back in the five days after a first day, by source; days without rows in each two hours aren't covered, and tell nothing."""
    e = events(spark, d)
    covered = e.groupBy("source", "day").agg(F.count_distinct(F.expr(f"us div {2 * HOUR}")).alias("cells")).where("cells >= 12")
    return A.retention(e, ["source"], "user_id", "day", 5, covered)


@query(f"""WITH {EV}, o AS (SELECT DISTINCT object_id, object_id % 10 AS parent, user_id FROM ev WHERE source = 'purchase'), p AS (SELECT DISTINCT object_id % 10 AS parent, user_id FROM ev WHERE source = 'view')
SELECT o.object_id, count(*) AS actors, count(p.user_id) AS common FROM o LEFT JOIN p ON o.parent = p.parent AND o.user_id = p.user_id GROUP BY 1""")
def parent_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many of an object's actors are also its parent's."""
    e = events(spark, d).withColumn("parent", F.col("object_id") % 10)
    o = e.where("source = 'purchase'").select("object_id", "parent", "user_id").distinct()
    p = e.where("source = 'view'").select("parent", "user_id").distinct().withColumn("there", F.lit(1))
    return o.join(p, ["parent", "user_id"], "left").groupBy("object_id").agg(F.count(F.lit(1)).alias("actors"), F.count("there").alias("common"))


POOL_SQL = f"m AS (SELECT object_id % 10 AS topic, object_id AS member, CASE WHEN object_id % 7 = 0 THEN NULL ELSE CAST(count(*) FILTER (WHERE day = {AS_OF // DAY - 1}) AS BIGINT) END AS value FROM ev GROUP BY 1, 2)"


def pool_rows(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("object_id") % 7 != 0, F.count_if(F.col("day") == AS_OF // DAY - 1))
    g = events(spark, d).groupBy("object_id").agg(F.count_if(F.col("day") == AS_OF // DAY - 1).alias("c"))
    return g.select((F.col("object_id") % 10).alias("topic"), F.col("object_id").alias("member"), F.when(F.col("object_id") % 7 != 0, F.col("c")).alias("value"))


@query(f"""WITH {EV}, {POOL_SQL}, g AS (SELECT topic, count(*) AS members, count(value) AS observed, count(*) FILTER (WHERE value >= 4) AS active, arg_max(member, value * 1000 - member) FILTER (WHERE value IS NOT NULL) AS leader, coalesce(max(value) >= 4, false) AS lead FROM m GROUP BY 1)
SELECT topic, members, observed, active, round(observed / members::DOUBLE, 6) AS coverage, CASE WHEN observed > 0 THEN round(active / observed::DOUBLE, 6) END AS breadth, round(active / members::DOUBLE, 6) AS lower, round((active + members - observed) / members::DOUBLE, 6) AS upper, leader,
CASE WHEN observed > 1 THEN round((active - CASE WHEN lead THEN 1 ELSE 0 END) / (observed - 1)::DOUBLE, 6) END AS without_leader FROM g""")
def member_pool(spark: SparkSession, d: str) -> DataFrame:
    """How far activity has spread in a pool of members, with bounds for those unobserved."""
    out = ranking.pool(pool_rows(spark, d).where("value is not null or true"), "topic", "member", "value", F.col("value") >= 4)
    return out.select("topic", "members", "observed", "active", *r6("coverage", "breadth", "lower", "upper"), "leader", *r6("without_leader"))


@query(f"""WITH {EV}, a AS (SELECT DISTINCT object_id AS topic, user_id AS member FROM ev WHERE day = {AS_OF // DAY - 2}), b AS (SELECT DISTINCT object_id AS topic, user_id AS member FROM ev WHERE day = {AS_OF // DAY - 1}),
f AS (SELECT coalesce(a.topic, b.topic) AS topic, a.member AS x, b.member AS y FROM a FULL JOIN b ON a.topic = b.topic AND a.member = b.member)
SELECT topic, count(*) AS everyone, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS retained, count(*) FILTER (WHERE x IS NULL) AS entered, count(*) FILTER (WHERE y IS NULL) AS exited FROM f GROUP BY 1""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Union, retained, entered and exited members of two snapshots."""
    e = events(spark, d)
    day = lambda k, name: e.where(F.col("day") == AS_OF // DAY - k).select(F.col("object_id").alias("topic"), "user_id").distinct().withColumn(name, F.lit(True))
    j = day(2, "a").join(day(1, "b"), ["topic", "user_id"], "full")
    return j.groupBy("topic").agg(F.count(F.lit(1)).alias("everyone"), F.count_if(F.col("a") & F.col("b")).alias("retained"), F.count_if(F.col("a").isNull()).alias("entered"), F.count_if(F.col("b").isNull()).alias("exited"))


@query(f"""WITH {EV}, p AS (SELECT DISTINCT object_id, user_id FROM ev), s AS (SELECT object_id, count(*) n FROM p GROUP BY 1), x AS (SELECT a.object_id AS a, b.object_id AS b, count(*) AS both_n FROM p a JOIN p b ON a.user_id = b.user_id AND a.object_id < b.object_id GROUP BY 1, 2)
SELECT a, b, both_n AS "both", sa.n + sb.n - both_n AS "union", round(both_n::DOUBLE / (sa.n + sb.n - both_n), 6) AS jaccard FROM x JOIN s sa ON sa.object_id = a JOIN s sb ON sb.object_id = b WHERE both_n::DOUBLE / (sa.n + sb.n - both_n) >= 0.35""")
def topic_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pools that share much of their members."""
    o = A.overlap(events(spark, d), "object_id", "user_id", 0.35)
    return o.select("a", "b", "both", "union", *r6("jaccard"))


@query(f"WITH {EV} SELECT source, day, sha256(string_agg(u, ',' ORDER BY u)) AS pool_hash FROM (SELECT DISTINCT source, day, CAST(user_id AS VARCHAR) AS u FROM ev) GROUP BY 1, 2")
def set_hash_query(spark: SparkSession, d: str) -> DataFrame:
    """One digest for a pool, whatever the order of its members."""
    return events(spark, d).groupBy("source", "day").agg(set_hash(F.col("user_id")).alias("pool_hash"))


QUERIES["set_hash"], SQL["set_hash"] = QUERIES.pop("set_hash_query"), SQL.pop("set_hash_query")


@query(f"""WITH {EV}, t AS (SELECT source, user_id, us, lag(us) OVER (PARTITION BY source, user_id ORDER BY us, event_id) AS before FROM ev), e AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR us - before > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY source, user_id ORDER BY us) AS BIGINT) AS episode FROM t)
SELECT source, user_id, episode, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM e GROUP BY 1, 2, 3""")
def episode_continuity(spark: SparkSession, d: str) -> DataFrame:
    """An episode goes on where the next activity comes within a day."""
    e = S.islands(events(spark, d), ["source", "user_id"], "us", DAY, F.lit(True))
    return e.groupBy("source", "user_id", F.col("run").alias("episode")).agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"))


_BANDS = "CASE WHEN errors * 3 >= n AND errors >= 2 THEN 'risk' WHEN n >= 7 THEN 'confirmed' WHEN n >= 4 THEN 'discovery' WHEN n = 1 THEN 'insufficient' ELSE 'monitor' END"
_STAGES = "CASE WHEN n >= 9 THEN 'high_heat' WHEN n > coalesce(n_before, 0) AND n_before IS NULL THEN 'newborn' WHEN n > n_before THEN 'warming' WHEN purchases >= 2 THEN 'information_new' ELSE 'stable' END"


@query(f"""WITH {EV}, g0 AS (SELECT object_id, day, count(*) AS n, count(*) FILTER (WHERE source = 'error') AS errors, count(*) FILTER (WHERE source = 'purchase') AS purchases, count(DISTINCT source) AS observed, max(us) AS evidence FROM ev GROUP BY 1, 2),
p AS (SELECT object_id, day, list(DISTINCT user_id) AS pool FROM ev GROUP BY 1, 2), wm AS (SELECT object_id, day, count(*) AS warm FROM (SELECT object_id, day, source FROM ev GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2),
g1 AS (SELECT g0.*, pool, coalesce(warm, 0) AS warm, day // 5 AS version, (day + 1) * {DAY} AS at_us, lag(n) OVER (PARTITION BY object_id ORDER BY day) AS n_before FROM g0 JOIN p USING (object_id, day) LEFT JOIN wm USING (object_id, day)),
g2 AS (SELECT *, {_BANDS} AS band0, {_STAGES} AS stage0 FROM g1), g3 AS (SELECT *, band0 <> 'risk' AND observed >= 3 AND observed / 5 >= 0.6::DOUBLE AND warm >= 3 AND warm / observed >= 0.3::DOUBLE AS spreads FROM g2),
g4 AS (SELECT *, CASE WHEN spreads THEN 'discovery' ELSE band0 END AS band, CASE WHEN spreads THEN 'diffusing' ELSE stage0 END AS stage FROM g3),
r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY at_us) AS i FROM g4),
f AS (SELECT a.*, b.stage AS previous_stage, a.band IN ('discovery', 'confirmed') AS active, coalesce(a.band IN ('discovery', 'confirmed') AND b.band IN ('discovery', 'confirmed') AND a.at_us - b.evidence <= {2 * DAY}, false) AS same_episode,
  b.version IS NOT NULL AND b.version = a.version AS comparable, len(list_filter(a.pool, lambda x: NOT list_contains(b.pool, x))) AS e, len(list_filter(b.pool, lambda x: NOT list_contains(a.pool, x))) AS x, len(list_filter(a.pool, lambda x: list_contains(b.pool, x))) AS k FROM r a LEFT JOIN r b ON a.object_id = b.object_id AND b.i = a.i - 1),
o AS (SELECT f.object_id, f.i, min(z.at_us) AS earliest FROM f JOIN f z ON z.object_id = f.object_id AND z.i < f.i AND z.active GROUP BY 1, 2),
h AS (SELECT f.*, earliest, active AND NOT same_episode AS begins FROM f LEFT JOIN o USING (object_id, i))
SELECT object_id, day, CASE WHEN active THEN (SELECT max(z.at_us) FROM h z WHERE z.object_id = h.object_id AND z.i <= h.i AND z.begins) END AS first_detected, CASE WHEN active THEN (SELECT count(*) FROM h z WHERE z.object_id = h.object_id AND z.i <= h.i AND z.begins) END AS episode, same_episode, previous_stage, stage IS DISTINCT FROM previous_stage AS transition,
CASE WHEN spreads THEN 'diffusing' WHEN begins AND coalesce(earliest < at_us - {3 * DAY}, false) THEN 'returning' WHEN band = 'risk' THEN 'risk' WHEN stage = 'newborn' THEN 'newborn' WHEN stage = 'high_heat' THEN 'sustained' WHEN stage = 'warming' THEN 'warming' WHEN stage = 'information_new' THEN 'information' WHEN band = 'insufficient' THEN 'insufficient' ELSE 'monitor' END AS "group",
comparable, CASE WHEN comparable THEN e END AS entered, CASE WHEN comparable THEN x END AS departed, CASE WHEN comparable THEN k END AS retained FROM h""")
def selection_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Daily runs over all objects: episodes carried on within two days, groups, overrides by pools that spread, pools against the run before."""
    e = events(spark, d)
    runs = e.groupBy("object_id", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "error").alias("errors"), F.count_if(F.col("source") == "purchase").alias("purchases"), F.count_distinct("source").alias("observed"), F.max("us").alias("evidence"))
    pools = e.select("object_id", "day", "user_id").distinct().groupBy("object_id", "day").agg(F.collect_list("user_id").alias("pool"))
    warm = e.groupBy("object_id", "day", "source").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").groupBy("object_id", "day").agg(F.count(F.lit(1)).alias("warm"))
    runs = runs.join(pools, ["object_id", "day"]).join(warm, ["object_id", "day"], "left").withColumns({"warm": F.coalesce("warm", F.lit(0)), "version": F.expr("day div 5"), "at_us": (F.col("day") + 1) * DAY})
    runs = runs.withColumn("n_before", F.lag("n").over(Window.partitionBy("object_id").orderBy("day"))).withColumns({"band": F.expr(_BANDS), "stage": F.expr(_STAGES)})
    runs = lifecycle.diffusing(runs, F.col("observed"), F.lit(5), F.col("warm"))
    runs = lifecycle.pool_changes(lifecycle.followed(runs, "object_id", "at_us", "evidence", 2 * DAY, 3 * DAY), "object_id", "at_us", "pool", "version")
    return runs.select("object_id", "day", "first_detected", "episode", "same_episode", "previous_stage", "transition", "group", "comparable", "entered", "departed", "retained")


FEATURES_SQL = f"""f0 AS (SELECT source AS family, object_id, count(*) FILTER (WHERE day >= {AS_OF // DAY - 3} AND day < {AS_OF // DAY}) AS v, count(*) FILTER (WHERE day >= {AS_OF // DAY - 6} AND day < {AS_OF // DAY - 3}) AS p, count(DISTINCT user_id) AS actors FROM ev WHERE obs_us <= {AS_OF} GROUP BY 1, 2),
f1 AS (SELECT *, ln((v + 1) / (p + 1)::DOUBLE) AS growth, median(ln((v + 1) / (p + 1)::DOUBLE)) OVER (PARTITION BY family) AS common,
ln(((v + 1) / (sum(v) OVER (PARTITION BY family) + count(*) OVER (PARTITION BY family))::DOUBLE) / ((p + 1) / (sum(p) OVER (PARTITION BY family) + count(*) OVER (PARTITION BY family))::DOUBLE)) AS share_change FROM f0),
feat AS (SELECT object_id, median(growth) AS growth, median(growth - common) AS relative, median(share_change) AS share_change, CAST(sum(actors) AS BIGINT) AS actors, max(v) AS peak, bool_or(v = 0) AS any_quiet FROM f1 GROUP BY 1)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    e = bitemporal.as_of(events(spark, d), AS_OF)
    day = AS_OF // DAY
    f = e.groupBy(F.col("source").alias("family"), "object_id").agg(
        F.count_if((F.col("day") >= day - 3) & (F.col("day") < day)).alias("v"), F.count_if((F.col("day") >= day - 6) & (F.col("day") < day - 3)).alias("p"), F.countDistinct("user_id").alias("actors")
    )
    w = Window.partitionBy("family")
    n = F.count(F.lit(1)).over(w)
    f = f.withColumn("growth", F.log((F.col("v") + 1) / (F.col("p") + 1)))
    f = f.withColumn("common", F.median("growth").over(w)).withColumn("share_change", F.log(((F.col("v") + 1) / (F.sum("v").over(w) + n)) / ((F.col("p") + 1) / (F.sum("p").over(w) + n))))
    return f.groupBy("object_id").agg(
        F.median("growth").alias("growth"), F.median(F.col("growth") - F.col("common")).alias("relative"), F.median("share_change").alias("share_change"), F.sum("actors").alias("actors"), F.max("v").alias("peak"), F.bool_or(F.col("v") == 0).alias("any_quiet")
    )


@query(f"WITH {EV}, {FEATURES_SQL} SELECT object_id, round(growth, 6) AS growth, round(relative, 6) AS relative, round(share_change, 6) AS share_change, actors, peak, any_quiet FROM feat")
def features_cross_section(spark: SparkSession, d: str) -> DataFrame:
    """Growth, against the common part, and change of share, by the median of families."""
    return features(spark, d).select("object_id", *r6("growth", "relative", "share_change"), "actors", "peak", "any_quiet")


def _mid(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) - 1 + 0.5 * count(*) OVER (PARTITION BY {c})) / count(*) OVER ()"


# Logarithms may differ in the last place between engines; rounding keeps ties of one engine ties of the other.
SCORES_SQL = f"""fr AS (SELECT object_id, round(growth, 9) AS growth, round(relative, 9) AS relative, round(share_change, 9) AS share_change, actors, peak FROM feat),
pr AS (SELECT object_id, {_mid('growth')} AS pg, {_mid('relative')} AS pr, {_mid('share_change')} AS ps, {_mid('actors')} AS pa, {_mid('peak')} AS pp FROM fr),
sc AS (SELECT object_id, CAST((pg + pp) / 2 * 100 AS DOUBLE) AS attention, CAST((pr + ps) / 2 * 100 AS DOUBLE) AS relative_score, CAST(pa * 100 AS DOUBLE) AS participation FROM pr)"""

COMPONENTS = {"attention": ["growth", "peak"], "relative_score": ["relative", "share_change"], "participation": ["actors"]}


def scored(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d).select("object_id", *[F.round(c, 9).alias(c) for c in ("growth", "relative", "share_change")], "actors", "peak")
    # Each feature is ordered for itself: they are worked out once.
    return ranking.percentile_scores(files.kept(f, "features"), COMPONENTS)


@query(f"WITH {EV}, {FEATURES_SQL}, {SCORES_SQL} SELECT object_id, round(attention, 4) AS attention, round(relative_score, 4) AS relative_score, round(participation, 4) AS participation FROM sc")
def midrank_scores(spark: SparkSession, d: str) -> DataFrame:
    """Component scores as means of mid-ranks."""
    return scored(spark, d).select("object_id", *[F.round(c, 4).alias(c) for c in COMPONENTS])


@query(f"""WITH {EV}, {FEATURES_SQL}, {SCORES_SQL}, h AS (SELECT object_id, object_id % 3 AS kind, round((attention + relative_score + participation) / 3, 6) AS discovery, CASE WHEN object_id % 11 <> 0 THEN round((attention + participation) / 2, 6) END AS research FROM sc)
SELECT object_id, kind, round(discovery, 4) AS discovery, round(research, 4) AS research, row_number() OVER (PARTITION BY kind ORDER BY discovery DESC NULLS LAST, object_id) AS rank_discovery,
CASE WHEN research IS NOT NULL THEN row_number() OVER (PARTITION BY kind ORDER BY research DESC NULLS LAST, object_id) END AS rank_research FROM h""")
def two_head_rank(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings within each kind; the unmeasured have no rank."""
    s = scored(spark, d)
    s = s.select("object_id", (F.col("object_id") % 3).alias("kind"), F.round((F.col("attention") + F.col("relative_score") + F.col("participation")) / 3, 6).alias("discovery"), F.when(F.col("object_id") % 11 != 0, F.round((F.col("attention") + F.col("participation")) / 2, 6)).alias("research"))
    out = ranking.two_head_rank(files.kept(s, "scores"), {"discovery": "discovery", "research": "research"}, ["kind"], "object_id")
    return out.select("object_id", "kind", F.round("discovery", 4).alias("discovery"), F.round("research", 4).alias("research"), "rank_discovery", "rank_research")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS at, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WHERE c_acctbal IS NOT NULL)
SELECT c_mktsegment AS segment, max(n) AS n, max(CASE WHEN at = n // 3 + 1 THEN c_acctbal END) AS low, max(CASE WHEN at = (2 * n) // 3 + 1 THEN c_acctbal END) AS high FROM c GROUP BY 1""".replace(" AS at,", " AS pos,").replace("WHEN at =", "WHEN pos ="))
def terciles(spark: SparkSession, d: str) -> DataFrame:
    """Cut points of a segment's balances, by place."""
    return ranking.terciles(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "segment"), "c_acctbal", "segment")


@query("""WITH h AS (SELECT c_custkey, c_nationkey, c_mktsegment, sha256('s1:' || c_custkey) AS h, sha256('s1:' || c_nationkey || ':' || c_mktsegment) AS s FROM customer), t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY h) AS turn FROM h)
SELECT c_custkey, c_nationkey, c_mktsegment, turn FROM t WHERE turn <= 100 ORDER BY turn, s, h LIMIT 100""")
def stratified_controls(spark: SparkSession, d: str) -> DataFrame:
    """A control sample, one of each stratum in turn, by hash."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return ranking.stratified(c, ["c_nationkey", "c_mktsegment"], "c_custkey", 100, "s1").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("turn").cast("long").alias("turn"))


@query(f"""WITH {EV}, u AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1) SELECT user_id, n, CAST(rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS DOUBLE) AS average_rank FROM u""")
def average_rank_source(spark: SparkSession, d: str) -> DataFrame:
    """Ranks at ingest; ties share the mean of their places."""
    u = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("down", -F.col("n"))
    return ranking.average_ranks(u, "down", "average_rank").select("user_id", "n", "average_rank")


@query("""WITH q AS (SELECT l_shipdate, p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS price, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS symbols, CAST(sum(n) AS BIGINT) AS rows_n, CAST(sum(volume) AS DOUBLE) AS volume, round(median(price), 7) AS median_price, count(*) >= 15 AS complete FROM q GROUP BY 1""")
def market_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """The market's row of a day, complete only with enough symbols."""
    q = quotes(spark, d)
    return q.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("symbols"), F.sum("n").alias("rows_n"), F.sum("volume").alias("volume"), F.round(F.median("price"), 7).alias("median_price"), (F.count(F.lit(1)) >= 15).alias("complete"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return j.groupBy("l_shipdate", "p_brand").agg((dec("l_extendedprice") / F.count(F.lit(1))).alias("price"), dec("l_quantity").alias("volume"), F.count(F.lit(1)).alias("n"))


TRADING_SQL = """q AS (SELECT l_shipdate, p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS price, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
rt AS (SELECT *, price / lag(price) OVER (PARTITION BY p_brand ORDER BY l_shipdate) - 1 AS ret FROM q)"""


@query(f"""WITH {TRADING_SQL} SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n, round(avg(ret), 6) AS equal_weight, round(CAST(count(*) FILTER (WHERE ret > 0) AS DOUBLE) / count(*), 6) AS breadth, CASE WHEN count(*) > 1 THEN round((sum(ret) - max(ret)) / (count(*) - 1), 6) END AS without_leader,
round(CAST(sum(volume) FILTER (WHERE p_brand <= 'Brand#2') AS DOUBLE) / sum(volume), 6) AS volume_share FROM rt WHERE ret IS NOT NULL GROUP BY 1""")
def trading_panel(spark: SparkSession, d: str) -> DataFrame:
    """A day's mean return, breadth, mean without the leader, share of volume."""
    r = quotes(spark, d).withColumn("ret", F.col("price") / F.lag("price").over(Window.partitionBy("p_brand").orderBy("l_shipdate")) - 1).where("ret is not null")
    n = F.count(F.lit(1))
    return r.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(
        n.alias("n"), F.round(F.avg("ret"), 6).alias("equal_weight"), F.round(F.count_if(F.col("ret") > 0).cast("double") / n, 6).alias("breadth"), F.when(n > 1, F.round((F.sum("ret") - F.max("ret")) / (n - 1), 6)).alias("without_leader"), F.round(F.sum(F.when(F.col("p_brand") <= "Brand#2", F.col("volume"))) / F.sum("volume"), 6).alias("volume_share")
    )


@query(f"""WITH {EV}, g AS (SELECT object_id, count(*) FILTER (WHERE source = 'error') AS negative, count(*) AS n, count(DISTINCT source) AS families, max(v) > 95 AS material, count(*) FILTER (WHERE day = {AS_OF // DAY - 1}) AS today, count(*) FILTER (WHERE day = {AS_OF // DAY - 2}) AS before FROM ev WHERE obs_us <= {AS_OF} GROUP BY 1)
SELECT object_id, CASE WHEN negative >= 2 AND negative / n::DOUBLE >= 0.28 THEN 'negative_attention' WHEN families >= 5 AND today >= 6 AND today > before THEN 'accelerating' WHEN today >= 6 THEN 'high_heat' WHEN today > before THEN 'warming' WHEN material THEN 'information_new' WHEN today < before THEN 'fading' ELSE 'stable' END AS stage FROM g""")
def stage_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that holds names the stage."""
    day = AS_OF // DAY
    g = bitemporal.as_of(events(spark, d), AS_OF).groupBy("object_id").agg(
        F.count_if(F.col("source") == "error").alias("negative"), F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("families"), (F.max("v") > 95).alias("material"), F.count_if(F.col("day") == day - 1).alias("today"), F.count_if(F.col("day") == day - 2).alias("before")
    )
    up = F.col("today") > F.col("before")
    return g.select(
        "object_id",
        F.when((F.col("negative") >= 2) & (F.col("negative") / F.col("n") >= 0.28), "negative_attention")
        .when((F.col("families") >= 5) & (F.col("today") >= 6) & up, "accelerating")
        .when(F.col("today") >= 6, "high_heat")
        .when(up, "warming")
        .when(F.col("material"), "information_new")
        .when(F.col("today") < F.col("before"), "fading")
        .otherwise("stable")
        .alias("stage"),
    )


_T = AS_OF // DAY
_EVIDENCE = f"""g AS (SELECT object_id, source, count(*) FILTER (WHERE day = {_T - 1}) AS t, count(*) FILTER (WHERE day = {_T - 2}) AS y, count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day FROM known WHERE object_id % 37 <> 5 GROUP BY 1, 2),
x AS (SELECT object_id, source AS family, source <> 'signup' AND object_id % 41 <> 7 AS usable, last_day < {_T - 5} AS stale, t >= 2 AS high, t > y AND object_id % 3 <> 0 AS rising, days >= 9 AS long_history, t AS persistence, CASE WHEN t + y > 0 THEN CAST(t - y AS DOUBLE) END AS velocity, first_day >= {_T - 9} AS entered, source = 'error' AS jumped, t AS observations FROM g),
i AS (SELECT object_id, count(*) FILTER (WHERE source = 'error') AS negative, count(*) FILTER (WHERE source = 'error') / CAST(count(*) AS DOUBLE) AS negative_share, coalesce(max(CASE WHEN day = {_T - 1} THEN v END) > 60, false) AS material, object_id % 23 = 4 AS flagged FROM known GROUP BY 1)"""


@query(f"""WITH {EV}, known AS (SELECT * FROM ev WHERE obs_us <= {AS_OF} AND us < {AS_OF}), {_EVIDENCE},
l AS (SELECT *, usable AND NOT stale AS live, usable AND NOT stale AND high AND long_history AND persistence >= 2 AS strict FROM x),
a AS (SELECT i.*, coalesce(n, 0) AS n, coalesce(fam, 0) AS fam, * EXCLUDE (object_id, negative, negative_share, material, flagged, n, fam) FROM i LEFT JOIN (SELECT object_id, count(*) AS n, count(DISTINCT CASE WHEN strict THEN family END) AS fam, count(*) FILTER (WHERE strict AND velocity < 0) AS down, count(*) FILTER (WHERE strict AND velocity >= 0) AS up, count(*) FILTER (WHERE strict AND rising) AS rise,
  count(*) FILTER (WHERE live AND entered AND (jumped OR observations >= 1)) AS fresh, count(*) FILTER (WHERE live AND rising) AS rises, count(*) FILTER (WHERE live AND high) AS highs, count(*) FILTER (WHERE live AND high AND coalesce(velocity, 0) >= 0) AS holds, count(*) FILTER (WHERE live AND velocity < 0) AS slow, count(*) FILTER (WHERE live) AS lives, count(*) FILTER (WHERE live AND long_history) AS old FROM l GROUP BY 1) e USING (object_id)),
s AS (SELECT object_id, CASE WHEN negative >= 2 AND negative_share >= 0.3 THEN 'risk/negative_attention' WHEN flagged THEN 'risk/risk_excluded' WHEN fam >= 2 AND down > 0 AND up = 0 THEN 'monitor/decelerating' WHEN fam >= 2 AND rise > 0 THEN 'confirmed/accelerating' WHEN fam >= 2 THEN 'confirmed/high_heat' WHEN fresh > 0 THEN 'discovery/newborn' WHEN rises > 0 THEN 'discovery/warming'
  WHEN highs > 0 AND holds = 0 THEN 'monitor/decelerating' WHEN highs > 0 THEN 'monitor/high_heat' WHEN material THEN 'monitor/information_new' WHEN slow > 0 THEN 'monitor/fading' WHEN n > 0 AND coalesce(lives, 0) = 0 THEN 'insufficient/stale' WHEN coalesce(lives, 0) = 0 THEN 'insufficient/insufficient' WHEN old = 0 THEN 'insufficient/cold_start' ELSE 'monitor/stable' END AS b FROM a)
SELECT object_id, split_part(b, '/', 2) AS stage, split_part(b, '/', 1) AS band FROM s""")
def stage_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The stage and band of every object, of fifteen outcomes; evidence of a source is what its rows of the last two days say, by fixed rules."""
    known = bitemporal.as_of(events(spark, d), AS_OF)
    n = lambda k: F.count_if(F.col("day") == _T - k)
    g = known.where("object_id % 37 <> 5").groupBy("object_id", "source").agg(n(1).alias("t"), n(2).alias("y"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    evidence = g.select(
        "object_id",
        F.col("source").alias("family"),
        ((F.col("source") != "signup") & (F.col("object_id") % 41 != 7)).alias("usable"),
        (F.col("last_day") < _T - 5).alias("stale"),
        (F.col("t") >= 2).alias("high"),
        ((F.col("t") > F.col("y")) & (F.col("object_id") % 3 != 0)).alias("rising"),
        (F.col("days") >= 9).alias("long_history"),
        F.col("t").alias("persistence"),
        F.when(F.col("t") + F.col("y") > 0, (F.col("t") - F.col("y")).cast("double")).alias("velocity"),
        (F.col("first_day") >= _T - 9).alias("entered"),
        (F.col("source") == "error").alias("jumped"),
        F.col("t").alias("observations"),
    )
    news = known.groupBy("object_id").agg(F.count_if(F.col("source") == "error").alias("negative"), (F.count_if(F.col("source") == "error").cast("double") / F.count(F.lit(1))).alias("negative_share"), F.coalesce(F.max(F.when(F.col("day") == _T - 1, F.col("v"))) > 60, F.lit(False)).alias("material"))
    return ranking.stages(evidence, news.withColumn("flagged", F.col("object_id") % 23 == 4), "object_id")


@query(f"""WITH {EV}, k AS (SELECT object_id, source, count(*) AS n, max(us) AS last_us, CAST(sum(v) AS DOUBLE) / count(*) AS mean_v FROM ev WHERE obs_us <= {AS_OF} GROUP BY 1, 2)
SELECT object_id, count(*) AS families, median(n) AS median_n, max(n) AS max_n, max(last_us) AS last_us, count(*) FILTER (WHERE mean_v > 20) AS strong, bool_or(mean_v > 25) AS any_strong, arg_max(source, n * 100000 + length(source)) AS top_source FROM k GROUP BY 1""".replace("arg_max(source, n * 100000 + length(source)) AS top_source", "max(struct_pack(n := n, source := source)).source AS top_source"))
def evidence_fold(spark: SparkSession, d: str) -> DataFrame:
    """An object's evidence over its families."""
    k = bitemporal.as_of(events(spark, d), AS_OF).groupBy("object_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us"), (F.sum("v").cast("double") / F.count(F.lit(1))).alias("mean_v"))
    return k.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("families"), F.median("n").alias("median_n"), F.max("n").alias("max_n"), F.max("last_us").alias("last_us"), F.count_if(F.col("mean_v") > 20).alias("strong"), F.bool_or(F.col("mean_v") > 25).alias("any_strong"), F.max(F.struct("n", "source"))["source"].alias("top_source")
    )


@query(f"""WITH {EV}, d AS (SELECT user_id, day, count(*) AS n FROM ev GROUP BY 1, 2), e AS (SELECT *, CASE WHEN n >= 3 THEN 'hot' WHEN n = 2 THEN 'warm' ELSE 'cool' END AS grp, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS episode FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) <= 1 THEN 0 ELSE 1 END AS cut FROM d)),
f AS (SELECT user_id, episode, count(*) AS days, arg_max(n, day) AS last_lead, max(day) - min(day) AS duration FROM e GROUP BY 1, 2)
SELECT user_id % 10 AS grp, count(*) AS episodes, median(last_lead) AS median_lead, round(avg(CASE WHEN last_lead >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS attention_first, median(duration) AS median_duration FROM f GROUP BY 1""")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Runs folded to episodes, the last lead of each, and their medians."""
    x = events(spark, d).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    e = S.islands(x, ["user_id"], "day", 1, F.lit(True))
    f = e.groupBy("user_id", "run").agg(F.max_by("n", "day").alias("last_lead"), (F.max("day") - F.min("day")).alias("duration"))
    return f.groupBy((F.col("user_id") % 10).alias("grp")).agg(F.count(F.lit(1)).alias("episodes"), F.median("last_lead").alias("median_lead"), F.round(F.avg((F.col("last_lead") >= 2).cast("double")), 6).alias("attention_first"), F.median("duration").alias("median_duration"))


@query("SELECT r_name AS market, count(DISTINCT n_nationkey) AS nations, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1")
def overseas_map(spark: SparkSession, d: str) -> DataFrame:
    """Objects of other markets mapped to home ones."""
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("market")).agg(F.countDistinct("n_nationkey").alias("nations"), F.count(F.lit(1)).alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


_HALF = f"CASE WHEN pmod({{0}}, {DAY}) < {12 * HOUR} THEN 'morning' ELSE 'afternoon' END"


@query(f"""WITH {EV}, s AS (SELECT object_id, day, CASE WHEN (us % {DAY}) < {12 * HOUR} THEN 'morning' ELSE 'afternoon' END AS session, count(DISTINCT user_id) AS actors, count(*) AS posts, count(DISTINCT source) AS platforms FROM ev GROUP BY 1, 2, 3),
w AS (SELECT object_id, user_id, us, (us // {_FIVE} + k) * {_FIVE} AS e FROM ev, range(1, 13) r(k)), o AS (SELECT *, e - e % {DAY} + CASE WHEN e % {DAY} > {_OPEN} THEN {_OPEN} ELSE 0 END AS open_us FROM w),
c AS (SELECT object_id, e, {", ".join(f"count(DISTINCT CASE WHEN us >= e - {m * _MIN} THEN user_id END) AS a{m}" for m in (15, 30, 60))} FROM o WHERE us >= greatest(e - {60 * _MIN}, open_us) GROUP BY 1, 2),
p AS (SELECT object_id, e // {DAY} AS day, CASE WHEN (e % {DAY}) < {12 * HOUR} THEN 'morning' ELSE 'afternoon' END AS session, max(a15) AS peak_15, max(a30) AS peak_30, max(a60) AS peak_60 FROM c GROUP BY 1, 2, 3),
m AS (SELECT DISTINCT object_id, day, user_id FROM ev WHERE us % {DAY} < {12 * HOUR}), r AS (SELECT object_id, day, 'afternoon' AS session, count(DISTINCT user_id) AS retained FROM ev JOIN m USING (object_id, day, user_id) WHERE us % {DAY} >= {12 * HOUR} GROUP BY 1, 2)
SELECT s.*, coalesce(peak_15, 0) AS peak_15, coalesce(peak_30, 0) AS peak_30, coalesce(peak_60, 0) AS peak_60, CASE WHEN session = 'afternoon' THEN coalesce(retained, 0) END AS retained FROM s LEFT JOIN p USING (object_id, day, session) LEFT JOIN r USING (object_id, day, session)""")
def detail_view(spark: SparkSession, d: str) -> DataFrame:
    """Of every object by half day: actors, posts, platforms, the most actors of 15, 30 and 60 minutes, and who of the morning came back."""
    e = events(spark, d)
    half = F.expr(_HALF.format("us")).alias("session")
    halves = e.groupBy("object_id", "day", half).agg(F.countDistinct("user_id").alias("actors"), F.count(F.lit(1)).alias("posts"), F.countDistinct("source").alias("platforms"))
    sliding = A.sliding_actors(e, ["object_id"], "us", "user_id", (15, 30, 60))
    peaks = sliding.groupBy("object_id", F.expr(f"end div {DAY}").alias("day"), F.expr(_HALF.format("end")).alias("session")).agg(*[F.max(f"actors_{m}").alias(f"peak_{m}") for m in (15, 30, 60)])
    both = e.groupBy("object_id", "day", "user_id").agg(F.count_distinct(F.expr(_HALF.format("us"))).alias("halves")).where("halves = 2")
    back = both.groupBy("object_id", "day").agg(F.count(F.lit(1)).alias("back"))
    out = halves.join(peaks, ["object_id", "day", "session"], "left").join(back, ["object_id", "day"], "left")
    return out.select("object_id", "day", "session", "actors", "posts", "platforms", *[F.coalesce(f"peak_{m}", F.lit(0)).alias(f"peak_{m}") for m in (15, 30, 60)], F.when(F.col("session") == "afternoon", F.coalesce("back", F.lit(0))).alias("retained"))
