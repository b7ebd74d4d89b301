"""Series evidence over event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio, robust_z
from tidemark.operators import asof, bitemporal
from tidemark.operators import series as S

from .base import AS_OF, DAY, EV, HOUR, MINUTE, events, registered

QUERIES, SQL, query = registered()

HOURLY_SQL = f"{EV}, h AS (SELECT source, us // {HOUR} AS tick, (us // {HOUR}) % 24 AS slot, day, CAST(count(*) AS BIGINT) AS value FROM ev GROUP BY 1, 2, 3, 4)"


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def hourly(spark: SparkSession, d: str, *extra) -> DataFrame:
    return hourly_of(events(spark, d), *extra)


def hourly_of(e: DataFrame, *extra) -> DataFrame:
    tick = F.expr(f"us div {HOUR}")
    return e.groupBy("source", *extra, tick.alias("tick"), (tick % 24).alias("slot"), "day").agg(F.count(F.lit(1)).alias("value"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("source", "day").agg(F.count(F.lit(1)).alias("value"))


_SPANS = (1, 3, 5, 20)
_LOOK = ", ".join(f"n_{n}, round(mean_{n}, 6) AS mean_{n}, round(value - mean_{n}, 6) AS delta_{n}" for n in _SPANS)
_LOOKW = ", ".join(
    f"count(value) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS n_{n}, CAST(sum(value) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS DOUBLE) / nullif(count(value) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0) AS mean_{n}"
    for n in _SPANS
)


@query(f"""WITH {EV}, d AS (SELECT source, day, count(*) AS value FROM ev GROUP BY 1, 2),
l AS (SELECT *, {_LOOKW}, sum(value) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) s3, sum(value) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN 23 PRECEDING AND 4 PRECEDING) s20,
count(value) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) n23 FROM d)
SELECT source, day, value, {_LOOK}, CASE WHEN n23 = 23 AND s20 > 0 THEN round((CAST(s3 AS DOUBLE) / 3) / (CAST(s20 AS DOUBLE) / 20), 6) END AS g_3_20 FROM l""")
def lookback_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Mean, number and change at several look-backs."""
    out = S.lookbacks(daily(spark, d), ["source"], "day", "value", _SPANS)
    return out.select("source", "day", "value", *[c for n in _SPANS for c in (F.col(f"n_{n}"), *r6(f"mean_{n}", f"delta_{n}"))], *r6("g_3_20"))


_CLOCK = "PARTITION BY source, slot ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING"
CLOCK_SQL = f"""{HOURLY_SQL}, c0 AS (SELECT *, count(*) OVER ({_CLOCK}) AS n_hist, CAST(sum(value) OVER ({_CLOCK}) AS DOUBLE) AS s_hist, list(value) OVER ({_CLOCK}) AS past,
count(*) OVER (PARTITION BY source, slot ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n_5 FROM h),
c AS (SELECT source, tick, slot, day, value, n_hist, n_5, s_hist / nullif(n_hist, 0) AS mean_hist, CASE WHEN n_hist >= 4 THEN value / (s_hist / n_hist) END AS q,
CASE WHEN n_hist > 0 THEN (len(list_filter(past, lambda x: x < value)) + 0.5 * len(list_filter(past, lambda x: x = value))) / n_hist END AS hist_pct FROM c0)"""


@query(f"WITH {CLOCK_SQL} SELECT source, tick, value, n_hist, round(mean_hist, 6) AS mean_hist, round(q, 6) AS q, round(CAST(hist_pct AS DOUBLE), 6) AS hist_pct FROM c")
def same_clock_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Each hour against the same hour of earlier days."""
    return S.same_clock(hourly(spark, d), ["source"], "slot", "day", "value").select("source", "tick", "value", "n_hist", *r6("mean_hist", "q", "hist_pct"))


@query(f"""WITH {EV}, l AS (SELECT * FROM ev WHERE source = 'purchase'), r AS (SELECT user_id, us, max(v) AS v FROM ev WHERE source = 'view' GROUP BY 1, 2)
SELECT l.event_id, l.user_id, l.us, CASE WHEN r.us >= l.us - {12 * HOUR} THEN r.us END AS asof_us, CAST(CASE WHEN r.us >= l.us - {12 * HOUR} THEN r.v END AS DOUBLE) AS asof_v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us >= r.us""")
def backward_asof(spark: SparkSession, d: str) -> DataFrame:
    """The last view at most twelve hours before a purchase."""
    e = events(spark, d)
    left, right = e.where("source = 'purchase'").select("event_id", "user_id", "us"), e.where("source = 'view'").select("user_id", F.col("us").alias("r_us"), "v")
    out = asof.backward_asof(left, right.withColumnRenamed("r_us", "seen").withColumnRenamed("seen", "us2"), ["user_id"], "us", "us2", 12 * HOUR, ["v"])
    return out.select("event_id", "user_id", "us", F.col("asof_us2").alias("asof_us"), F.col("asof_v").cast("double").alias("asof_v"))


@query(f"""WITH {EV}, l AS (SELECT * FROM ev WHERE source = 'view'), r AS (SELECT user_id, us, max(v) AS v FROM ev WHERE source = 'purchase' GROUP BY 1, 2)
SELECT l.event_id, l.user_id, l.us, CASE WHEN r.us <= l.us + {12 * HOUR} THEN r.us END AS asof_us, CAST(CASE WHEN r.us <= l.us + {12 * HOUR} THEN r.v END AS DOUBLE) AS asof_v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us <= r.us""")
def forward_asof(spark: SparkSession, d: str) -> DataFrame:
    """The first purchase at most twelve hours after a view."""
    e = events(spark, d)
    left, right = e.where("source = 'view'").select("event_id", "user_id", "us"), e.where("source = 'purchase'").select("user_id", F.col("us").alias("us2"), "v")
    out = asof.forward_asof(left, right, ["user_id"], "us", "us2", 12 * HOUR, ["v"])
    return out.select("event_id", "user_id", "us", F.col("asof_us2").alias("asof_us"), F.col("asof_v").cast("double").alias("asof_v"))


@query(f"""WITH {EV}, d AS (SELECT object_id, day, ln(1 + CAST(sum(v) AS DOUBLE)) AS x FROM ev GROUP BY 1, 2), m AS (SELECT object_id, median(x) AS med, count(*) AS n FROM d GROUP BY 1),
a AS (SELECT d.object_id, median(abs(x - med)) AS mad FROM d JOIN m USING (object_id) GROUP BY 1)
SELECT object_id, day, CASE WHEN n >= 4 AND mad > 1e-9 THEN round((x - med) / (1.4826 * mad), 6) END AS z FROM d JOIN m USING (object_id) JOIN a USING (object_id)""")
def robust_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """A4: robust z of each day's volume by object."""
    x = events(spark, d).groupBy("object_id", "day").agg(F.log1p(F.sum("v").cast("double")).alias("x"))
    w = Window.partitionBy("object_id")
    x = x.withColumn("med", F.median("x").over(w)).withColumn("n", F.count("x").over(w)).withColumn("mad", F.median(F.abs(F.col("x") - F.col("med"))).over(w))
    return x.select("object_id", "day", F.round(robust_z(F.col("x"), F.col("med"), F.col("mad"), F.col("n")), 6).alias("z"))


@query(f"""WITH {HOURLY_SQL}, s AS (SELECT *, count(*) OVER ({_CLOCK}) AS n, CAST(sum(value) OVER ({_CLOCK}) AS DOUBLE) AS s1, CAST(sum(value * value) OVER ({_CLOCK}) AS DOUBLE) AS s2 FROM h),
m AS (SELECT *, s1 / nullif(n, 0) AS mu, CASE WHEN n > 1 THEN (s2 - n * (s1 / n) * (s1 / n)) / (n - 1) ELSE 0 END AS var FROM s)
SELECT source, tick, n, round((value + 1) / (mu + 1), 6) AS surprise, round((value - mu) / sqrt(greatest(mu, var, 1) * (1 + 1.0::DOUBLE / n)), 6) AS z FROM m WHERE n > 0 UNION ALL SELECT source, tick, n, NULL, NULL FROM m WHERE n = 0""")
def count_surprise(spark: SparkSession, d: str) -> DataFrame:
    """A5: shrunken ratio and z of an hour's count."""
    return S.count_surprise(hourly(spark, d), ["source"], "slot", "day", "value").select("source", "tick", "n", *r6("surprise", "z"))


_MOVE = "PARTITION BY source, day ORDER BY tick RANGE BETWEEN {0} PRECEDING AND {0} PRECEDING"
MOVE_SQL = f"{CLOCK_SQL}, mv AS (SELECT *, max(q) OVER ({_MOVE.format(1)}) AS q1, max(q) OVER ({_MOVE.format(2)}) AS q2 FROM c)"


@query(f"WITH {MOVE_SQL} SELECT source, tick, round(q - q1, 6) AS velocity, round(q - 2 * q1 + q2, 6) AS acceleration FROM mv")
def velocity_acceleration(spark: SparkSession, d: str) -> DataFrame:
    """First and second difference of q on one day."""
    out = S.change(S.same_clock(hourly(spark, d), ["source"], "slot", "day", "value"), ["source"], "day", "tick")
    return out.select("source", "tick", *r6("velocity", "acceleration"))


def evidence(spark: SparkSession, d: str, at: int = AS_OF) -> DataFrame:
    known = bitemporal.as_of(events(spark, d), at, end=at)
    points = hourly_of(known).withColumn("us", F.col("tick") * HOUR)
    return S.snapshot_evidence(points, ["source"], at, HOUR)


EVIDENCE_SQL = (
    MOVE_SQL.replace(" FROM ev GROUP BY 1, 2, 3, 4)", f" FROM ev WHERE obs_us <= {AS_OF} AND us < {AS_OF} GROUP BY 1, 2, 3, 4)")
    + f""", e AS (SELECT source, tick * {HOUR} AS us, value, n_hist, q, CAST(hist_pct AS DOUBLE) AS hist_pct, q - q1 AS velocity, q - 2 * q1 + q2 AS acceleration, n_hist >= 16 AND n_5 >= 4 AS history_ok, coalesce(q >= 1.5, false) AS high,
coalesce(q >= 1.5 AND q - q1 > 0, false) AS rising, coalesce(q - q1 >= 0.2, false) AS accelerating, CASE WHEN coalesce(q >= 1.5 AND q1 >= 1.5, false) THEN 2 WHEN coalesce(q >= 1.5, false) THEN 1 ELSE 0 END AS persistence,
{AS_OF} - tick * {HOUR} > {HOUR * 5 // 2} AS stale FROM mv QUALIFY row_number() OVER (PARTITION BY source ORDER BY tick DESC) = 1)"""
)


@query(f"WITH {EVIDENCE_SQL} SELECT source, us, value, n_hist, round(q, 6) AS q, round(hist_pct, 6) AS hist_pct, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, history_ok, high, rising, accelerating, persistence, stale FROM e")
def snapshot_evidence(spark: SparkSession, d: str) -> DataFrame:
    """O1: the evidence row of every series at a moment."""
    e = evidence(spark, d)
    return e.select("source", "us", "value", "n_hist", *r6("q", "hist_pct", "velocity", "acceleration"), "history_ok", "high", "rising", "accelerating", "persistence", "stale")


@query(f"""WITH {EV}, s AS (SELECT source, us // {HOUR} AS tick, count(*) AS n FROM ev GROUP BY 1, 2), t AS (SELECT source, tick * {HOUR} AS us, CAST(sum(n) OVER (PARTITION BY source ORDER BY tick) AS BIGINT) AS stock FROM s)
SELECT a.source, a.us, a.stock, CASE WHEN b.us >= a.us - {6 * HOUR} - {HOUR} THEN a.stock - b.stock END AS flow FROM t a ASOF LEFT JOIN t b ON a.source = b.source AND a.us - {6 * HOUR} >= b.us""")
def net_flow(spark: SparkSession, d: str) -> DataFrame:
    """O3: what a running total gained in six hours."""
    s = hourly(spark, d)
    w = Window.partitionBy("source").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    stock = s.select("source", (F.col("tick") * HOUR).alias("us"), F.sum("value").over(w).alias("stock"))
    return S.flows(stock, ["source"], "us", "stock", 6 * HOUR, HOUR)


RUNS_SQL = f"""{CLOCK_SQL}, n AS (SELECT *, tick * {HOUR} AS us, row_number() OVER (PARTITION BY source ORDER BY tick) = 1 AS first_of_series FROM c), hot AS (SELECT * FROM n WHERE q >= 1.2),
g AS (SELECT *, CASE WHEN lag(us) OVER (PARTITION BY source ORDER BY us) IS NULL OR us - lag(us) OVER (PARTITION BY source ORDER BY us) > {2 * HOUR} THEN 1 ELSE 0 END AS cut FROM hot),
runs AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY source ORDER BY us) AS BIGINT) AS run FROM g)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    points = S.same_clock(hourly(spark, d), ["source"], "slot", "day", "value").withColumn("us", F.col("tick") * HOUR)
    return S.islands(points, ["source"], "us", 2 * HOUR, F.col("q") >= 1.2)


@query(f"WITH {RUNS_SQL} SELECT source, run, min(us) AS start_us, max(us) AS end_us, count(*) AS n, bool_or(first_of_series) AS left_censored FROM runs GROUP BY 1, 2")
def hot_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of hot hours, two hours apart at most."""
    return runs(spark, d).groupBy("source", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"), F.bool_or("first_of_series").alias("left_censored"))


@query(f"""WITH {RUNS_SQL}, p AS (SELECT *, (greatest(q - 1, 0) + lead(greatest(q - 1, 0)) OVER w) / 2.0::DOUBLE * CAST(lead(us) OVER w - us AS DOUBLE) AS part FROM runs WINDOW w AS (PARTITION BY source, run ORDER BY us))
SELECT source, run, round(coalesce(sum(part), 0) / {HOUR}, 6) AS area_hours, round(max(q), 6) AS peak, round(arg_max(q, us) / max(q), 6) AS retention FROM p GROUP BY 1, 2""")
def excess_auc(spark: SparkSession, d: str) -> DataFrame:
    """Area over the baseline, peak and retention of each hot run."""
    out = S.excess_area(runs(spark, d), ["source", "run"], "us", "q")
    return out.select("source", "run", F.round(F.col("area") / HOUR, 6).alias("area_hours"), *r6("peak", "retention"))


_CROSS = "SELECT object_id, min(us) AS onset_us FROM (SELECT *, lag({0}) OVER (PARTITION BY object_id ORDER BY us) AS p, lag(us) OVER (PARTITION BY object_id ORDER BY us) AS pus FROM m) WHERE p < {1} AND {0} >= {1} AND us - pus <= {2} GROUP BY 1"


@query(f"""WITH {EV}, m AS (SELECT object_id, (us // {6 * HOUR}) * {6 * HOUR} AS us, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM ev GROUP BY 1, 2),
a AS ({_CROSS.format('n', 2, DAY)}), b AS ({_CROSS.format('total', 60, DAY)})
SELECT object_id, a.onset_us AS attention_us, b.onset_us AS value_us, (b.onset_us - a.onset_us) // {MINUTE} AS lead_minutes FROM a FULL JOIN b USING (object_id)""")
def onset_lead(spark: SparkSession, d: str) -> DataFrame:
    """Minutes from the onset of attention to the onset of value."""
    cell = F.expr(f"(us div {6 * HOUR}) * {6 * HOUR}")
    m = events(spark, d).groupBy("object_id", cell.alias("us")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total"))
    a = S.first_crossing(m, ["object_id"], "us", "n", 2, DAY).withColumnRenamed("onset_us", "attention_us")
    b = S.first_crossing(m, ["object_id"], "us", "total", 60, DAY).withColumnRenamed("onset_us", "value_us")
    return a.join(b, "object_id", "full").withColumn("lead_minutes", F.expr(f"(value_us - attention_us) div {MINUTE}"))


@query(f"""WITH {EV}, d AS (SELECT source, day, CAST(sum(v) AS DOUBLE) AS v FROM ev GROUP BY 1, 2) SELECT source, day, round(v - lag(v, 1) OVER w, 2) AS change_1, round(v - 2 * lag(v, 1) OVER w + lag(v, 2) OVER w, 2) AS change_2 FROM d WINDOW w AS (PARTITION BY source ORDER BY day)""")
def daily_lag(spark: SparkSession, d: str) -> DataFrame:
    """The session before, by place rather than by date."""
    x = events(spark, d).groupBy("source", "day").agg(F.sum("v").cast("double").alias("v"))
    w = Window.partitionBy("source").orderBy("day")
    return x.select("source", "day", F.round(F.col("v") - F.lag("v", 1).over(w), 2).alias("change_1"), F.round(F.col("v") - 2 * F.lag("v", 1).over(w) + F.lag("v", 2).over(w), 2).alias("change_2"))


@query(f"""WITH {EV}, c AS (SELECT source, day, us // {HOUR} AS cell, count(DISTINCT object_id) AS coverage, CAST(sum(v) AS DOUBLE) AS amount FROM ev GROUP BY 1, 2, 3), m AS (SELECT us // {HOUR} AS cell, CAST(sum(v) AS DOUBLE) AS market FROM ev GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY source, day ORDER BY coverage DESC, cell DESC) AS rn FROM c)
SELECT source, day, cell, coverage, amount, round(amount / market, 6) AS share FROM b JOIN m USING (cell) WHERE rn = 1""")
def cell_join(spark: SparkSession, d: str) -> DataFrame:
    """The cell of widest coverage, the latest of equals, against the market's same cell."""
    e = events(spark, d).withColumn("cell", F.expr(f"us div {HOUR}"))
    c = e.groupBy("source", "day", "cell").agg(F.countDistinct("object_id").alias("coverage"), F.sum("v").cast("double").alias("amount"))
    best = bitemporal.latest(c, ["source", "day"], F.col("coverage"), F.col("cell"))
    market = e.groupBy("cell").agg(F.sum("v").cast("double").alias("market"))
    return best.join(market, "cell").select("source", "day", "cell", "coverage", "amount", F.round(ratio(F.col("amount"), F.col("market")), 6).alias("share"))


@query(f"WITH {EV} SELECT source, day, count(DISTINCT us // 900000000) AS buckets FROM ev GROUP BY 1, 2")
def observation_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct quarter hours with an observation."""
    return events(spark, d).groupBy("source", "day").agg(F.countDistinct(F.expr("us div 900000000")).alias("buckets"))


@query(f"""WITH {EV}, d AS (SELECT object_id, day, count(*) AS value FROM ev GROUP BY 1, 2), p AS (SELECT *, list(value) OVER (PARTITION BY object_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM d)
SELECT object_id, day, value, CASE WHEN len(past) > 0 THEN round(CAST((len(list_filter(past, lambda x: x < value)) + 0.5 * len(list_filter(past, lambda x: x = value))) / len(past) AS DOUBLE), 6) END AS pct FROM p""")
def hist_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Mid-rank of a value among its own earlier values."""
    x = events(spark, d).groupBy("object_id", "day").agg(F.count(F.lit(1)).alias("value"))
    w = Window.partitionBy("object_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("past", F.collect_list("value").over(w))
    pct = (F.size(F.filter("past", lambda y: y < F.col("value"))) + 0.5 * F.size(F.filter("past", lambda y: y == F.col("value")))) / F.size("past")
    return x.select("object_id", "day", "value", F.when(F.size("past") > 0, F.round(pct, 6)).alias("pct"))


@query(f"""WITH {HOURLY_SQL}, a AS (SELECT source, day, tick, value, value >= 3 AS active, lag(value) OVER (PARTITION BY source, day ORDER BY tick) AS before FROM h), k AS (SELECT * FROM a WHERE before IS NULL OR before <> value)
SELECT source, day, count(*) AS points, round(CAST(count(*) FILTER (WHERE active) AS DOUBLE) / count(*), 6) AS active_share, max(value) AS peak, round(CAST(arg_max(value, tick) AS DOUBLE) / max(value), 6) AS tail_retention FROM k GROUP BY 1, 2""")
def path_retention(spark: SparkSession, d: str) -> DataFrame:
    """The day's path without repeats: active share, peak, what is left of it at the end."""
    w = Window.partitionBy("source", "day").orderBy("tick")
    k = hourly(spark, d).withColumn("before", F.lag("value").over(w)).where("before is null or before <> value")
    return k.groupBy("source", "day").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.count_if(F.col("value") >= 3).cast("double") / F.count(F.lit(1)), 6).alias("active_share"), F.max("value").alias("peak"), F.round(F.max_by("value", "tick").cast("double") / F.max("value"), 6).alias("tail_retention")
    )


@query(f"WITH {CLOCK_SQL}, k AS (SELECT *, lag(value) OVER (PARTITION BY source, day ORDER BY tick) AS before FROM c) SELECT source, day, tick, value, round(q, 6) AS q FROM k WHERE (before IS NULL OR before <> value) AND q IS NOT NULL")
def run_path(spark: SparkSession, d: str) -> DataFrame:
    """The day's path of a series, repeated observations left out."""
    c = S.same_clock(hourly(spark, d), ["source"], "slot", "day", "value")
    k = c.withColumn("before", F.lag("value").over(Window.partitionBy("source", "day").orderBy("tick")))
    return k.where("(before is null or before <> value) and q is not null").select("source", "day", "tick", "value", *r6("q"))
