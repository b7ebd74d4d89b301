"""Calendars, graphs, forward labels, event studies and model evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import average_rank, interpolate, logistic, ratio
from tidemark.operators import asof, bitemporal, calendar, graph, learn, ranking
from tidemark.sources import files

from .base import AS_OF, DAY, EV, HOUR, events, micros, registered, table

QUERIES, SQL, query = registered()


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


HOLIDAYS = [("2024-01-01", "2024-01-01"), ("2024-02-09", "2024-02-17")]
EARLY = ["2024-02-08"]
CAL_SQL = """cal AS (SELECT CAST(d AS DATE) AS day, NOT (dayofweek(d) IN (0, 6) OR d = DATE '2024-01-01' OR (d >= DATE '2024-02-09' AND d <= DATE '2024-02-17')) AS is_open, CAST(d AS DATE) = DATE '2024-02-08' AS early FROM range(DATE '2024-01-01', DATE '2024-04-01', INTERVAL 1 DAY) t(d)),
sp AS (SELECT day, o AS open_min, CASE WHEN early THEN least(c, 690) ELSE c END AS close_min FROM cal, (VALUES (570, 690), (780, 900)) s(o, c) WHERE is_open AND (NOT early OR o < 690)),
ck AS (SELECT *, coalesce(sum(close_min - open_min) OVER (ORDER BY day, open_min ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sp)"""


def days(spark: SparkSession) -> DataFrame:
    return calendar.calendar(spark, "2024-01-01", "2024-03-31", HOLIDAYS, EARLY)


@query(f"WITH {CAL_SQL} SELECT * FROM cal")
def calendar_gen(spark: SparkSession, d: str) -> DataFrame:
    """Every date, open or not."""
    return days(spark)


@query(f"WITH {CAL_SQL} SELECT day, CAST(open_min AS BIGINT) AS open_min, CAST(close_min AS BIGINT) AS close_min, CAST(before AS BIGINT) AS before FROM ck")
def trading_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Sessions and the open minutes before each."""
    return calendar.clock(days(spark)).select("day", *[F.col(c).cast("long").alias(c) for c in ("open_min", "close_min", "before")])


@query(f"WITH {CAL_SQL}, n AS (SELECT day, row_number() OVER (ORDER BY day) AS nth FROM cal WHERE is_open) SELECT a.day, a.nth, b.day AS twentieth_before FROM n a LEFT JOIN n b ON b.nth = a.nth - 20")
def open_days(spark: SparkSession, d: str) -> DataFrame:
    """Open days, and the one twenty sessions before."""
    n = calendar.numbered(days(spark)).select("day", "nth")
    return n.join(n.select(F.col("day").alias("twentieth_before"), (F.col("nth") + 20).alias("nth")), "nth", "left").select("day", "nth", "twentieth_before")


@query(f"""WITH {EV}, {CAL_SQL}, m AS (SELECT event_id, CAST(make_timestamp(us) AS DATE) AS day, (us % {DAY}) // 60000000 AS minute FROM ev) SELECT phase, count(*) AS n FROM (SELECT CASE WHEN NOT is_open OR minute < 570 THEN 'premarket' WHEN minute < 900 THEN 'intraday' ELSE 'postmarket' END AS phase FROM m JOIN cal USING (day)) GROUP BY 1""")
def phase(spark: SparkSession, d: str) -> DataFrame:
    """The phase of the day of each event."""
    m = events(spark, d).select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("day"), F.expr(f"(us % {DAY}) div 60000000").alias("minute"))
    return m.join(F.broadcast(days(spark)), "day").groupBy(calendar.phase(F.col("is_open"), F.col("minute")).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, {CAL_SQL}, m AS (SELECT event_id AS id, CAST(make_timestamp(us) AS DATE) AS day0, (us % {DAY}) // 60000000 AS minute FROM ev),
s AS (SELECT id, arg_min(before + CASE WHEN ck.day = day0 THEN greatest(minute - open_min, 0) ELSE 0 END + 60, (epoch(ck.day) * 2000 + open_min)) AS goal FROM m JOIN ck ON ck.day > day0 OR (ck.day = day0 AND ck.close_min > minute) GROUP BY id)
SELECT id, ck.day AS due_day, CAST(open_min + goal - before AS BIGINT) AS due_min FROM s JOIN ck ON goal > before AND goal <= before + close_min - open_min""")
def deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Sixty open minutes after every event, over breaks and closed days."""
    m = events(spark, d).select(F.col("event_id").alias("id"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("day"), F.expr(f"(us % {DAY}) div 60000000").alias("minute"))
    return calendar.advance(m, days(spark), 60)


EDGE_SQL = """eg AS (SELECT p_brand AS topic, p_partkey AS symbol, CASE p_partkey % 3 WHEN 0 THEN 'direct_business' WHEN 1 THEN 'industry_transmission' ELSE 'narrative' END AS relation, CASE p_partkey % 4 WHEN 0 THEN 'mass_production' WHEN 1 THEN 'pilot' WHEN 2 THEN 'research' ELSE 'other' END AS stage,
CASE WHEN p_partkey % 5 <> 0 THEN p_size / 50.0::DOUBLE END AS share, CASE WHEN p_partkey % 13 <> 0 THEN 'url' END AS evidence, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS direction FROM part),
ex AS (SELECT *, CASE WHEN evidence IS NOT NULL THEN (CASE relation WHEN 'direct_business' THEN 1.0::DOUBLE WHEN 'industry_transmission' THEN 0.55::DOUBLE ELSE 0 END) * (CASE stage WHEN 'mass_production' THEN 1.0::DOUBLE WHEN 'pilot' THEN 0.5::DOUBLE WHEN 'research' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END) END AS structural,
CASE WHEN evidence IS NOT NULL THEN (CASE relation WHEN 'direct_business' THEN 1.0::DOUBLE WHEN 'industry_transmission' THEN 0.55::DOUBLE ELSE 0 END) * share END AS measured FROM eg)"""


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    e = table(spark, d, "part").select(
        F.col("p_brand").alias("topic"),
        k.alias("symbol"),
        F.when(k % 3 == 0, "direct_business").when(k % 3 == 1, "industry_transmission").otherwise("narrative").alias("relation"),
        F.when(k % 4 == 0, "mass_production").when(k % 4 == 1, "pilot").when(k % 4 == 2, "research").otherwise("other").alias("stage"),
        F.when(k % 5 != 0, F.col("p_size") / 50.0).alias("share"),
        F.when(k % 13 != 0, "url").alias("evidence"),
        F.when(k % 2 == 0, 1).otherwise(-1).alias("direction"),
    )
    return graph.exposure(e)


@query(f"WITH {EDGE_SQL} SELECT topic, symbol, round(structural, 6) AS structural, round(measured, 6) AS measured FROM ex")
def edge_exposure(spark: SparkSession, d: str) -> DataFrame:
    """What an edge weighs by its kind, and by a measured share."""
    return part_edges(spark, d).select("topic", "symbol", *r6("structural", "measured"))


@query(f"""WITH {EDGE_SQL}, bev AS (SELECT p_brand AS topic, l_returnflag AS event, CAST(count(*) AS DOUBLE) / 1000 AS importance FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT symbol, count(*) AS paths, round(max(coalesce(measured, structural) * direction * importance), 6) + 0.0::DOUBLE AS best, round(min(coalesce(measured, structural) * direction * importance), 6) + 0.0::DOUBLE AS worst FROM ex JOIN bev USING (topic) GROUP BY 1""")
def event_paths(spark: SparkSession, d: str) -> DataFrame:
    """A topic's events along its edges to each member."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic")), "l_partkey")
    ev = j.groupBy("topic", F.col("l_returnflag").alias("event")).agg((F.count(F.lit(1)).cast("double") / 1000).alias("importance"))
    return graph.paths(part_edges(spark, d), ev, "topic").groupBy("symbol").agg(F.count(F.lit(1)).alias("paths"), (F.round(F.max("impact"), 6) + 0.0).alias("best"), (F.round(F.min("impact"), 6) + 0.0).alias("worst"))


PAIR_SQL = f"""{EV}, q AS (SELECT DISTINCT user_id, day, source, object_id FROM ev), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, source ORDER BY object_id) AS place FROM q),
pr AS (SELECT a.object_id AS a, b.object_id AS b, count(DISTINCT (a.user_id, a.day)) AS n, count(DISTINCT a.source) AS families FROM k a JOIN k b ON a.user_id = b.user_id AND a.day = b.day AND a.source = b.source AND a.object_id < b.object_id WHERE a.place <= 30 AND b.place <= 30 GROUP BY 1, 2)"""


def pairs_of(spark: SparkSession, d: str, most: int | None) -> DataFrame:
    """A record: what one actor touches on one day through one source."""
    return graph.comentions(events(spark, d), ["user_id", "day"], "source", "object_id", most)


@query(f"WITH {PAIR_SQL} SELECT * FROM pr")
def comention_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Objects in one record, of which the thirty first make pairs: that bound is the operator's."""
    return pairs_of(spark, d, 30)


@query(f"WITH {PAIR_SQL.replace(' WHERE a.place <= 30 AND b.place <= 30', '')} SELECT * FROM pr")
def comention_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """Objects in one record, however many."""
    return pairs_of(spark, d, None)


@query(f"WITH {PAIR_SQL} SELECT * FROM pr ORDER BY n DESC, a, b LIMIT 100")
def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    """L4: the hundred strongest pairs; the limit is the graph's size."""
    return pairs_of(spark, d, 30).orderBy(F.desc("n"), "a", "b").limit(100)


_ALL_PAIRS = PAIR_SQL.replace(" WHERE a.place <= 30 AND b.place <= 30", "")


@query(f"WITH {_ALL_PAIRS}, r2 AS (SELECT a.object_id AS a, b.object_id AS b, count(*) AS n FROM q a JOIN q b ON a.user_id = b.user_id AND a.day = b.day AND a.source = b.source AND a.object_id < b.object_id GROUP BY 1, 2) SELECT a, b, n FROM r2 ORDER BY n DESC, a, b LIMIT 2000")
def strongest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """L4: the two thousand strongest pairs over all members of records, without listing all pairs; the limit is the graph's size. A fact is what an actor
    touches on a day through one source."""
    return graph.strongest_pairs(events(spark, d), ["user_id", "day", "source"], "object_id", 2000, lambda x: files.kept(x, "pairs"))[0]


PRICE_SQL = """px AS (SELECT p_brand AS oid, l_returnflag AS src, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS price, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
ch AS (SELECT oid, day, arg_max(price, CASE src WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS price, max(CASE src WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS priority FROM px GROUP BY 1, 2)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("oid")), "l_partkey")
    px = j.groupBy("oid", F.col("l_returnflag").alias("src"), F.col("l_shipdate").cast("date").alias("day")).agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("price"))
    rank = F.when(F.col("src") == "A", 3).when(F.col("src") == "N", 2).otherwise(1)
    return px.groupBy("oid", "day").agg(F.max_by("price", rank).alias("price"), F.max(rank).alias("priority"))


@query(f"WITH {PRICE_SQL} SELECT oid, day, round(price, 6) AS price, priority FROM ch")
def price_choice(spark: SparkSession, d: str) -> DataFrame:
    """Of several sources' prices of a day the preferred one."""
    return prices(spark, d).select("oid", "day", *r6("price"), "priority")


RETURN_SQL = f"""{PRICE_SQL}, rt AS (SELECT a.oid, a.day, b.day AS later, ln(b.price / a.price) AS ret, b.day - a.day AS gap FROM ch a ASOF LEFT JOIN ch b ON a.oid = b.oid AND CAST(a.day + INTERVAL 5 DAY AS DATE) <= b.day), rr AS (SELECT oid, day, CASE WHEN later <= CAST(day + INTERVAL 15 DAY AS DATE) THEN ret END AS ret FROM rt)"""


def returns(spark: SparkSession, d: str) -> DataFrame:
    p = prices(spark, d).select("oid", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("t"), "day", "price")
    left = p.select("oid", "day", "price", (F.col("t") + 5).alias("due"))
    right = p.select("oid", F.col("t").alias("at"), F.col("price").alias("later"))
    out = asof.forward_asof(left, right, ["oid"], "due", "at", 10, ["later"])
    return out.select("oid", "day", F.log(F.col("asof_later") / F.col("price")).alias("ret"))


@query(f"WITH {RETURN_SQL} SELECT oid, day, round(ret, 6) AS ret, CASE WHEN ret IS NULL THEN 'missing_observation' ELSE 'complete' END AS status FROM rr")
def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    """The return five days on, from the first price within ten more days."""
    return returns(spark, d).select("oid", "day", *r6("ret"), F.when(F.col("ret").isNull(), "missing_observation").otherwise("complete").alias("status"))


@query(f"""WITH {RETURN_SQL}, p AS (SELECT oid, day, ret, count(ret) OVER (PARTITION BY day) - CASE WHEN ret IS NOT NULL THEN 1 ELSE 0 END AS peers, sum(ret) OVER (PARTITION BY day) - coalesce(ret, 0) AS rest FROM rr)
SELECT oid, day, peers, CASE WHEN peers >= 3 THEN round(ret - rest / peers, 5) END AS relative FROM p""")
def relative_labels(spark: SparkSession, d: str) -> DataFrame:
    """A return against the mean of at least three others of the day."""
    out = ranking.leave_one_out(returns(spark, d), "day", "ret", 3)
    return out.select("oid", "day", "peers", F.round(F.col("ret") - F.col("peer_mean"), 5).alias("relative"))


@query(f"""WITH {EV}, m AS (SELECT object_id, source AS family, day, count(*) AS v FROM ev GROUP BY 1, 2, 3), x AS (SELECT a.object_id, a.day, a.family, ln((b.v + 20) / (a.v + 20)::DOUBLE) AS g FROM m a JOIN m b ON a.object_id = b.object_id AND a.family = b.family AND b.day = a.day + 1),
l AS (SELECT object_id, day, count(*) AS families, median(g) AS growth FROM x GROUP BY 1, 2) SELECT object_id, day, families, round(growth, 6) AS growth, CASE WHEN families >= 2 THEN CASE WHEN growth >= ln(1.05::DOUBLE) THEN 1 ELSE 0 END END AS label FROM l""")
def attention_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whether the median family grew by the next day; two families at least."""
    m = events(spark, d).groupBy("object_id", F.col("source").alias("family"), "day").agg(F.count(F.lit(1)).alias("v"))
    nxt = m.select("object_id", "family", (F.col("day") - 1).alias("day"), F.col("v").alias("w"))
    l = m.join(nxt, ["object_id", "family", "day"]).groupBy("object_id", "day").agg(F.count(F.lit(1)).alias("families"), F.median(F.log((F.col("w") + 20) / (F.col("v") + 20))).alias("growth"))
    return l.select("object_id", "day", "families", *r6("growth"), F.when(F.col("families") >= 2, F.when(F.col("growth") >= F.log(F.lit(1.05)), 1).otherwise(0)).alias("label"))


@query(f"""WITH {RETURN_SQL}, e AS (SELECT oid, day, ret, CASE WHEN ln(abs(hash_bucket) + 1) >= 0 THEN hash_bucket END AS grp FROM (SELECT *, CAST(right(oid, 1) AS BIGINT) % 3 AS hash_bucket FROM rr WHERE ret IS NOT NULL))
SELECT grp, year(day) AS "year", count(*) AS n, round(median(ret), 6) AS median_ret, round(CAST(count(*) FILTER (WHERE ret > 0) AS DOUBLE) / count(*), 6) AS positive FROM e GROUP BY GROUPING SETS ((grp, year(day)), (grp), ())""")
def event_study(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes by group, by group and year, and over all."""
    r = returns(spark, d).where("ret is not null").select((F.substring("oid", -1, 1).cast("long") % 3).alias("grp"), F.year("day").cast("long").alias("year"), "ret")
    return spark.sql('SELECT grp, year, count(*) AS n, round(median(ret), 6) AS median_ret, round(CAST(count_if(ret > 0) AS DOUBLE) / count(*), 6) AS positive FROM {r} GROUP BY GROUPING SETS ((grp, year), (grp), ())', r=r)


PANEL_SQL = f"""pn AS (SELECT object_id, day, count(*) AS f1, CAST(sum(v) AS DOUBLE) AS f2, count(DISTINCT user_id) AS f3 FROM ev GROUP BY 1, 2),
ds AS (SELECT a.object_id, a.day, a.f1, a.f2, a.f3, CASE WHEN coalesce(b.f1, 0) > a.f1 THEN 1 ELSE 0 END AS y FROM pn a LEFT JOIN pn b ON a.object_id = b.object_id AND b.day = a.day + 1 WHERE a.day < {AS_OF // DAY + 9})"""


def dataset(spark: SparkSession, d: str) -> DataFrame:
    p = events(spark, d).groupBy("object_id", "day").agg(F.count(F.lit(1)).alias("f1"), F.sum("v").cast("double").alias("f2"), F.countDistinct("user_id").alias("f3"))
    nxt = p.select("object_id", (F.col("day") - 1).alias("day"), F.col("f1").alias("next"))
    return p.where(F.col("day") < AS_OF // DAY + 9).join(nxt, ["object_id", "day"], "left").select("object_id", "day", "f1", "f2", "f3", F.when(F.coalesce("next", F.lit(0)) > F.col("f1"), 1).otherwise(0).alias("y"))


@query(f"WITH {EV}, {PANEL_SQL} SELECT * FROM ds")
def joined_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Features of a day with the outcome of the next."""
    return dataset(spark, d)


_FIRST = AS_OF // DAY - 19


@query(f"""WITH {EV}, {PANEL_SQL}, folds(fold, test_start) AS (VALUES (0, {_FIRST + 18}), (1, {_FIRST + 22})) SELECT fold, CASE WHEN day >= test_start THEN 'test' WHEN day >= test_start - 5 THEN 'validation' ELSE 'train' END AS part, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM ds, folds
WHERE (day >= test_start AND day < test_start + 4) OR (day >= test_start - 5 AND day < test_start - 1) OR (day >= test_start - 16 AND day < test_start - 6) GROUP BY 1, 2""")
def purged_folds(spark: SparkSession, d: str) -> DataFrame:
    """Train, validation and test in time, with days between them whose labels would reach across."""
    folds = learn.walk_forward(_FIRST, train=10, validation=4, test=4, embargo=1, step=4, folds=2)
    return learn.assign(dataset(spark, d), folds, "day").groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


_MARKETS = ("A", "HK", "US", "UK", "other")


@query(f"""WITH {EV}, z AS (SELECT event_id, us + (event_id % 300) * {DAY} AS utc_us, ['A', 'HK', 'US', 'UK', 'other'][object_id % 5 + 1] AS market FROM ev),
l AS (SELECT *, epoch_us(timezone(CASE market WHEN 'HK' THEN 'Asia/Hong_Kong' WHEN 'US' THEN 'America/New_York' WHEN 'UK' THEN 'Europe/London' ELSE 'Asia/Shanghai' END, make_timestamptz(utc_us))) AS local_us FROM z)
SELECT event_id, market, local_us, local_us // {DAY} AS local_day, (local_us % {DAY}) // {HOUR} AS local_hour FROM l""")
def market_zones(spark: SparkSession, d: str) -> DataFrame:
    """Instants on the clock of each one's market, over a year with summer time."""
    e = events(spark, d).select("event_id", (F.col("us") + (F.col("event_id") % 300) * DAY).alias("utc_us"), F.element_at(F.array(*map(F.lit, _MARKETS)), (F.col("object_id") % 5 + 1).cast("int")).alias("market"))
    local = e.select("event_id", "market", calendar.local_time(F.col("utc_us"), F.col("market")).alias("local_us"))
    return local.select("event_id", "market", "local_us", F.expr(f"local_us div {DAY}").alias("local_day"), F.expr(f"(local_us % {DAY}) div {HOUR}").alias("local_hour"))


COMPONENTS = 4


@query(f"""WITH e AS (SELECT vec_id, {", ".join(f"CASE WHEN vec_id % {11 + k} = {k} THEN NULL ELSE CAST(embedding[{k + 1}] AS DOUBLE) END AS x{k}" for k in range(COMPONENTS))} FROM embeddings), q AS (SELECT {", ".join(f"quantile_cont(x{k}, 0.01) AS lo{k}, quantile_cont(x{k}, 0.99) AS hi{k}, quantile_cont(x{k}, 0.5) AS mid{k}" for k in range(COMPONENTS))} FROM e),
w AS (SELECT vec_id, {", ".join(f"CASE WHEN x{k} IS NULL THEN mid{k} ELSE least(greatest(x{k}, lo{k}), hi{k}) END AS x{k}, x{k} IS NULL AS u{k}" for k in range(COMPONENTS))} FROM e, q), m AS (SELECT {", ".join(f"avg(x{k}) AS m{k}, stddev_pop(x{k}) AS s{k}" for k in range(COMPONENTS))} FROM w)
SELECT vec_id, {", ".join(f"round((x{k} - m{k}) / CASE WHEN s{k} < 1e-8 THEN 1 ELSE s{k} END, 6) AS z{k}, CAST(u{k} AS DOUBLE) AS missing{k}" for k in range(COMPONENTS))} FROM w, m""")
def preprocess(spark: SparkSession, d: str) -> DataFrame:
    """missing values by the median and flagged, clipped to the first and last per cent, then standardised; over the first four components, each
    unknown in some rows. The parameters are one row."""
    known = lambda k: F.when(F.col("vec_id") % (11 + k) != k, F.element_at("embedding", k + 1).cast("double"))
    e = table(spark, d, "embeddings").select("vec_id", *[known(k).alias(f"x{k}") for k in range(COMPONENTS)])
    z = learn.standardised(e, [f"x{k}" for k in range(COMPONENTS)])
    return z.select("vec_id", *[F.round(f"z_x{k}", 6).alias(f"z{k}") for k in range(COMPONENTS)], *[F.col(f"missing_x{k}").alias(f"missing{k}") for k in range(COMPONENTS)])


SCORED_SQL = f"{EV}, {PANEL_SQL}, sd AS (SELECT object_id, day, y, (f1 * 7 + object_id * 13) % 101 / 101.0::DOUBLE AS p, f2 AS value FROM ds)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).select("object_id", "day", "y", (((F.col("f1") * 7 + F.col("object_id") * 13) % 101) / 101.0).alias("p"), F.col("f2").alias("value"))


@query(f"""WITH {SCORED_SQL}, k AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY p) + (count(*) OVER (PARTITION BY day, p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (PARTITION BY day ORDER BY value) + (count(*) OVER (PARTITION BY day, value) - 1) / 2.0::DOUBLE AS rv, row_number() OVER (PARTITION BY day ORDER BY p DESC, object_id) AS place, row_number() OVER (PARTITION BY day ORDER BY y DESC, object_id) AS ideal, sum(y) OVER (PARTITION BY day) AS pos FROM sd)
SELECT day, count(*) AS n, round(corr(rp, rv), 6) AS rank_ic, round(avg(value) FILTER (WHERE place <= 10), 6) AS top_mean, round(CAST(sum(y) FILTER (WHERE place <= 10) AS DOUBLE) / 10, 6) AS top_rate, round(avg((p - y) * (p - y)), 6) AS brier,
CASE WHEN max(pos) > 0 THEN round(sum(CASE WHEN place <= 10 THEN y / log2(place + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN y / log2(ideal + 1) ELSE 0 END), 6) END AS ndcg,
CASE WHEN max(pos) > 0 THEN round(CAST(sum(y) FILTER (WHERE place <= 10) AS DOUBLE) / max(pos), 6) END AS recall FROM k GROUP BY 1""")
def daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation, the top ten's mean, rate and recall of known positives, Brier score and NDCG of each day."""
    return learn.daily_metrics(scored(spark, d), "day", "object_id", "p", "value", "y", 10).select("day", "n", *r6("rank_ic", "top_mean", "top_rate", "brier", "ndcg", "recall"))


@query(f"WITH {SCORED_SQL} SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM sd GROUP BY 1")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    """Ten bins of a reliability table."""
    return scored(spark, d).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("rate"))


@query(f"""WITH e AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, vec_id % 2 = 0 AS train FROM embeddings), q AS (SELECT {", ".join(f"quantile_cont(x, {k / 10}) AS q{k}" for k in range(1, 10))} FROM e WHERE train),
b AS (SELECT train, {" + ".join(f"CASE WHEN x > q{k} THEN 1 ELSE 0 END" for k in range(1, 10))} AS bin FROM e, q), c AS (SELECT bin, count(*) FILTER (WHERE train) + 0.5::DOUBLE AS a, count(*) FILTER (WHERE NOT train) + 0.5::DOUBLE AS b FROM b GROUP BY 1)
SELECT round(sum((a / sa - b / sb) * ln((a / sa) / (b / sb))), 6) AS psi, count(*) AS bins FROM c, (SELECT sum(a) AS sa, sum(b) AS sb FROM c)""")
def psi(spark: SparkSession, d: str) -> DataFrame:
    """Drift of one component between two halves, by the train half's deciles."""
    e = table(spark, d, "embeddings").select(F.element_at("embedding", 1).cast("double").alias("x"), (F.col("vec_id") % 2 == 0).alias("train"))
    return learn.psi(e, "x", "train").select(*r6("psi"), "bins")


@query("""WITH p AS (SELECT doc_id AS test, ((doc_id * 37) % 1000 + 1) / 2000.0::DOUBLE AS p FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS rk, count(*) OVER () AS n FROM p)
SELECT test, round(least(1.0::DOUBLE, min(p * n / rk) OVER (ORDER BY p DESC, test DESC)), 9) AS q FROM r""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Step-up adjustment of p-values; the smallest of p n / rank from the largest p down."""
    p = table(spark, d, "documents").select(F.col("doc_id").alias("test"), (((F.col("doc_id") * 37) % 1000 + 1) / 2000.0).alias("p"))
    return learn.bh_adjust(p, "test", "p").select("test", F.round("q", 9).alias("q"))


@query(f"WITH {SCORED_SQL}, a AS (SELECT day, object_id, p FROM sd WHERE object_id % 3 <> 0), b AS (SELECT day, object_id, value AS p2 FROM sd WHERE object_id % 2 = 0) SELECT day, count(*) AS cohort, round(avg(a.p), 8) AS mean_a, round(avg(b.p2), 8) AS mean_b FROM a JOIN b USING (day, object_id) GROUP BY 1")
def common_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Only what both sources have is compared."""
    s = scored(spark, d)
    j = s.where("object_id % 3 <> 0").select("day", "object_id", "p").join(s.where("object_id % 2 = 0").select("day", "object_id", F.col("value").alias("p2")), ["day", "object_id"])
    return j.groupBy("day").agg(F.count(F.lit(1)).alias("cohort"), F.round(F.avg("p"), 8).alias("mean_a"), F.round(F.avg("p2"), 8).alias("mean_b"))


@query(f"WITH {SCORED_SQL}, f AS (SELECT day, avg((p - y) * (p - y)) AS full_b, avg((p / 2 - y) * (p / 2 - y)) AS half_b FROM sd GROUP BY 1) SELECT day, round(full_b - half_b, 6) AS delta FROM f")
def paired_dates(spark: SparkSession, d: str) -> DataFrame:
    """Two variants paired by day."""
    s = scored(spark, d)
    one = lambda c, n: s.groupBy("day").agg(F.avg((c - F.col("y")) * (c - F.col("y"))).alias(n))
    return one(F.col("p"), "a").join(one(F.col("p") / 2, "b"), "day").select("day", F.round(F.col("a") - F.col("b"), 6).alias("delta"))


@query(f"WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY value) + (count(*) OVER (PARTITION BY day, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY day) AS n FROM sd) SELECT object_id, day, round(CASE WHEN n > 1 THEN (rk - 1) / (n - 1) END, 6) AS relevance, round(1.0::DOUBLE / n, 9) AS weight FROM r")
def relevance_grades(spark: SparkSession, d: str) -> DataFrame:
    """Relevance by average rank, and weights that count each day once."""
    n = F.count(F.lit(1)).over(Window.partitionBy("day"))
    s = scored(spark, d).withColumn("rk", average_rank(F.col("value"), "day")).withColumn("n", n)
    return s.select("object_id", "day", F.round(F.when(F.col("n") > 1, (F.col("rk") - 1) / (F.col("n") - 1)), 6).alias("relevance"), F.round(1.0 / F.col("n"), 9).alias("weight"))


@query("""WITH r AS (SELECT o_orderkey AS model_id, CASE WHEN o_orderkey % 2 = 0 THEN 'discovery' ELSE 'research' END AS head, epoch_us(o_orderdate) AS available_us, o_orderstatus <> 'P' AS active, o_orderpriority = '5-LOW' AS synthetic FROM orders)
SELECT head, model_id, available_us FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY available_us DESC, model_id DESC) AS rn FROM r WHERE available_us <= epoch_us(TIMESTAMP '1998-06-30') AND active AND NOT synthetic) WHERE rn = 1""")
def model_asof(spark: SparkSession, d: str) -> DataFrame:
    """The newest active model of each head that was available then, never a synthetic one (here: of low priority)."""
    r = table(spark, d, "orders").where("o_orderdate <= timestamp_ntz'1998-06-30 00:00:00' and o_orderstatus <> 'P' and o_orderpriority <> '5-LOW'")
    r = r.select(F.when(F.col("o_orderkey") % 2 == 0, "discovery").otherwise("research").alias("head"), F.col("o_orderkey").alias("model_id"), micros("o_orderdate").alias("available_us"))
    return bitemporal.latest(r, ["head"], F.col("available_us"), F.col("model_id")).select("head", "model_id", "available_us")


@query(f"SELECT source, quality, count(*) AS n, count(DISTINCT lang) AS langs, round(avg(toxic), 6) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def label_status(spark: SparkSession, d: str) -> DataFrame:
    """Labels by status."""
    j = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("source", "quality").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"), F.round(F.avg("toxic"), 6).alias("toxic_rate"))


@query("SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'none') AS decision, quality IS NOT NULL AS decided FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def feedback_join(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the decision on them, if any."""
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("decision"), F.col("quality").isNotNull().alias("decided"))


@query("SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def panel_label_join(spark: SparkSession, d: str) -> DataFrame:
    """Panel rows with their matured label."""
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS us, CAST(o_totalprice AS DECIMAL(18,2)) AS v, lag(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
SELECT o_custkey AS object_id, o_orderkey AS report_id, CASE WHEN prev IS NULL THEN 'first' WHEN abs(prev) < 1000 THEN 'near_zero_base' WHEN v > prev THEN 'up' WHEN v < prev THEN 'down' ELSE 'same' END AS revision, round(CASE WHEN prev >= 1000 THEN CAST(v AS DOUBLE) / CAST(prev AS DOUBLE) - 1 END, 6) AS change FROM o""")
def forecast_revision(spark: SparkSession, d: str) -> DataFrame:
    """A forecast against the one before of the same object."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("report_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"), "o_orderdate")
    prev = F.lag("v").over(Window.partitionBy("object_id").orderBy("o_orderdate", "report_id"))
    o = o.withColumn("prev", prev)
    kind = F.when(F.col("prev").isNull(), "first").when(F.abs("prev") < 1000, "near_zero_base").when(F.col("v") > F.col("prev"), "up").when(F.col("v") < F.col("prev"), "down").otherwise("same")
    return o.select("object_id", "report_id", kind.alias("revision"), F.round(F.when(F.col("prev") >= 1000, F.col("v").cast("double") / F.col("prev").cast("double") - 1), 6).alias("change"))


@query("SELECT o_custkey, o_orderstatus, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS previous_fact FROM orders")
def fact_lag(spark: SparkSession, d: str) -> DataFrame:
    """The last compatible fact before each."""
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.lag("o_orderkey").over(w).alias("previous_fact"))


@query(f"""WITH e AS (SELECT vec_id, {", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS x{k}" for k in range(3))} FROM embeddings) SELECT vec_id, round(1.0 / (1 + exp(-greatest(least(x0 * 4, 35), -35))), 6) AS p, CAST(sign(x1) AS BIGINT) AS side, round(x0 * 2.0::DOUBLE + x1 * -1.5::DOUBLE + x2 * 0.5::DOUBLE, 6) AS total, round(x1 * -1.5::DOUBLE, 6) AS part_1, CAST(floor(x2 * 10) AS BIGINT) AS cell FROM e""")
def numeric_exprs(spark: SparkSession, d: str) -> DataFrame:
    """Logistic, sign, floor and a linear score with its parts."""
    x = [F.element_at("embedding", k + 1).cast("double") for k in range(3)]
    return table(spark, d, "embeddings").select("vec_id", F.round(logistic(x[0] * 4), 6).alias("p"), F.signum(x[1]).cast("long").alias("side"), F.round(x[0] * 2.0 + x[1] * -1.5 + x[2] * 0.5, 6).alias("total"), F.round(x[1] * -1.5, 6).alias("part_1"), F.floor(x[2] * 10).alias("cell"))


@query("SELECT vec_id, round(CASE WHEN x <= -0.1 THEN 0 WHEN x < 0 THEN (x + 0.1) * 4 WHEN x < 0.1 THEN 0.4 + x * 6 ELSE 1 END, 6) AS calibrated FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def interpolate_query(spark: SparkSession, d: str) -> DataFrame:
    """a calibration curve between fixed points."""
    return table(spark, d, "embeddings").select("vec_id", F.round(interpolate(F.element_at("embedding", 1).cast("double"), [-0.1, 0.0, 0.1], [0.0, 0.4, 1.0]), 6).alias("calibrated"))


QUERIES["interpolate"], SQL["interpolate"] = QUERIES.pop("interpolate_query"), SQL.pop("interpolate_query")


@query(f"WITH {SCORED_SQL} SELECT day, count(*) AS n, round(1.0::DOUBLE / count(*), 9) AS weight, round(sum(y) * (1.0::DOUBLE / count(*)), 6) AS weighted_positives FROM sd GROUP BY 1")
def date_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights by which each day counts once, however many rows it has."""
    w = scored(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    return w.select("day", "n", F.round(1.0 / F.col("n"), 9).alias("weight"), F.round(F.col("positives") * (1.0 / F.col("n")), 6).alias("weighted_positives"))


_COEF = (("x0", 2.0, 0.3), ("x1", -1.5, 0.0), ("x2", 0.5, -0.2))


@query(f"""WITH e AS (SELECT vec_id, {", ".join(f"CASE WHEN vec_id % {7 + k} = 0 THEN NULL ELSE CAST(embedding[{k + 1}] AS DOUBLE) END AS x{k}" for k in range(3))} FROM embeddings), l AS ({" UNION ALL ".join(f"SELECT vec_id, '{n}' AS feature, coalesce(x{k}, 0) * {c}::DOUBLE + CASE WHEN x{k} IS NULL THEN {m}::DOUBLE ELSE 0 END AS part FROM e" for k, (n, c, m) in enumerate(_COEF))})
SELECT vec_id, feature, round(part, 6) + 0.0::DOUBLE AS part FROM l""")
def contributions(spark: SparkSession, d: str) -> DataFrame:
    """F8: what each feature adds to a linear score, the missing flag's weight where it is unknown."""
    e = table(spark, d, "embeddings").select("vec_id", *[F.when(F.col("vec_id") % (7 + k) != 0, F.element_at("embedding", k + 1).cast("double")).alias(f"x{k}") for k in range(3)])
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), (F.coalesce(F.col(n), F.lit(0.0)) * c + F.when(F.col(n).isNull(), m).otherwise(0.0)).alias("part")) for n, c, m in _COEF])
    return e.select("vec_id", F.explode(parts).alias("p")).select("vec_id", "p.feature", (F.round("p.part", 6) + 0.0).alias("part"))


@query()
def style_residual(spark: SparkSession, d: str) -> DataFrame:
    """What size, price and activity leave unexplained of a day's returns, by ridge with group dummies."""
    r = returns(spark, d).where("ret is not null").withColumn("month", F.date_trunc("month", "day").cast("date"))
    rows = r.groupBy("oid", "month").agg(F.avg("ret").alias("y"), F.count(F.lit(1)).cast("double").alias("x1"), F.max("ret").alias("x2")).withColumn("grp", F.substring("oid", -1, 1))
    return learn.residuals(rows, "month date, oid string", ["month"], "oid", "y", ["x1", "x2"], "grp", 1e-6)


@query()
def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Confidence interval of a mean of daily differences by moving blocks."""
    daily = paired_dates(spark, d).withColumn("variant", F.lit("full-half"))
    return learn.block_bootstrap(daily, "variant", "day", "delta", block=3, samples=500, seed=7)


@query()
def fit_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Ridge coefficients of the panel, equal to the closed form."""
    return learn.ridge(spark, learn.by_day(files.kept(dataset(spark, d), "panel"), "day", "w"), ["f1", "f2", "f3"], "y", 1.0, "w")


@query()
def fit_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Logistic coefficients of the panel."""
    return learn.logistic_fit(spark, learn.by_day(files.kept(dataset(spark, d), "panel"), "day", "w"), ["f1", "f2", "f3"], "y", 1.0, "w")


@query()
def isotonic(spark: SparkSession, d: str) -> DataFrame:
    """Isotonic calibration: its boundaries and values."""
    return learn.isotonic(spark, scored(spark, d), "p", "y")


@query()
def fit_ranker(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees of a pairwise objective on a day's quintiles of the next day's posts; scores of all days."""
    p = dataset(spark, d)
    quintile = F.ntile(5).over(Window.partitionBy("day").orderBy("f1", "object_id")) - 1
    nxt = p.select("object_id", (F.col("day") - 1).alias("day"), F.col("f1").alias("next"))
    graded = p.join(nxt, ["object_id", "day"]).withColumn("grade", F.ntile(5).over(Window.partitionBy("day").orderBy("next", "object_id")) - 1).withColumn("now", quintile)

    def keep(df: DataFrame) -> DataFrame:
        path = files.scratch(spark, "ranker")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return learn.pairwise_ranker(graded, ["f1", "f2", "f3"], "grade", "day", "object_id", split=_FIRST + 20, keep=keep)


@query()
def experiment(spark: SparkSession, d: str) -> DataFrame:
    """Variants by fold and penalty, chosen on validation, measured on test against the base rate, with intervals and adjusted p-values."""
    folds = learn.walk_forward(_FIRST, train=10, validation=4, test=4, embargo=1, step=4, folds=2)
    variants = {"full": ["f1", "f2", "f3"], "without_f1": ["f2", "f3"], "without_f2": ["f1", "f3"], "f1_only": ["f1"]}
    return learn.experiment(spark, dataset(spark, d), folds, variants, "y", "day", grid=(0.1, 10.0))


_FOLDS = learn.walk_forward(_FIRST, train=10, validation=4, test=4, embargo=1, step=4, folds=2)
_SCORES = {"model": "CAST(f1 AS DOUBLE) * 0.5 + f3", "heat_level": "CAST(f1 AS DOUBLE)", "heat_change": "CAST(f1 - before AS DOUBLE)", "price_change": "f2"}
_TESTED = " OR ".join(f"day >= {f.test[0]} AND day < {f.test[1]}" for f in _FOLDS)


def _scored_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset(spark, d).withColumn("before", F.lag("f1").over(Window.partitionBy("object_id").orderBy("day")))
    return rows.withColumns({f"s_{n}": F.expr(e) for n, e in _SCORES.items()})


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return learn.held_out_metrics(_scored_rows(spark, d), _FOLDS, {n: f"s_{n}" for n in _SCORES}, "day", "object_id", "f2", "y", 10)


@query(f"""WITH {EV}, {PANEL_SQL}, h0 AS (SELECT *, lag(f1) OVER (PARTITION BY object_id ORDER BY day) AS before FROM ds), h AS (SELECT * FROM h0 WHERE {_TESTED}), v AS ({" UNION ALL ".join(f"SELECT '{n}' AS variant, object_id, day, y, f2 AS value, coalesce({e}, 0) AS p FROM h" for n, e in _SCORES.items())}),
k AS (SELECT *, rank() OVER (PARTITION BY variant, day ORDER BY p) + (count(*) OVER (PARTITION BY variant, day, p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (PARTITION BY variant, day ORDER BY value) + (count(*) OVER (PARTITION BY variant, day, value) - 1) / 2.0::DOUBLE AS rv, row_number() OVER (PARTITION BY variant, day ORDER BY p DESC, object_id) AS place, row_number() OVER (PARTITION BY variant, day ORDER BY y DESC, object_id) AS ideal, sum(y) OVER (PARTITION BY variant, day) AS pos FROM v)
SELECT variant, day, count(*) AS n, round(corr(rp, rv), 6) AS rank_ic, round(avg(value) FILTER (WHERE place <= 10), 6) AS top_mean, round(CAST(sum(y) FILTER (WHERE place <= 10) AS DOUBLE) / 10, 6) AS top_rate,
CASE WHEN max(pos) > 0 THEN round(sum(CASE WHEN place <= 10 THEN y / log2(place + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN y / log2(ideal + 1) ELSE 0 END), 6) END AS ndcg, CASE WHEN max(pos) > 0 THEN round(CAST(sum(y) FILTER (WHERE place <= 10) AS DOUBLE) / max(pos), 6) END AS recall FROM k GROUP BY 1, 2""")
def baseline_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A fixed linear score and three plain baselines (heat, its change, price) on the same held-out days."""
    return _metrics(spark, d).select("variant", "day", "n", *r6("rank_ic", "top_mean", "top_rate", "ndcg", "recall"))


@query()
def paired_baselines(spark: SparkSession, d: str) -> DataFrame:
    """How much the score gains on each baseline, by matched days, with intervals and adjusted p-values by moving blocks."""
    return learn.paired(_metrics(spark, d), "model", "day", "top_mean")
