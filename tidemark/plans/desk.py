"""What a desk asks of the engine: columnar responses, bars, saved runs, archives, search, cards, redaction."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import calendar, graph
from tidemark.sources import files
from tidemark.streaming import windows

from . import market, people, storage
from .base import AS_OF, DAY, EV, HOUR, MINUTE, events, registered, table

QUERIES, SQL, query = registered()


@query(f"WITH {EV} SELECT source, event_id, user_id, CAST(v AS VARCHAR) AS value FROM ev")
def columnar_source(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a source as field names and lists of values, turned into rows; a page is a source's quarter of an hour."""
    fields = F.array(*map(F.lit, ("event_id", "user_id", "value")))
    item = F.array(F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("v").cast("string"))
    pages = events(spark, d).groupBy("source", F.expr(f"us div {15 * MINUTE}").alias("page")).agg(F.collect_list(item).alias("items"))
    responses = pages.select("source", F.to_json(F.struct(fields.alias("fields"), "items")).alias("body"))
    parsed = responses.select("source", F.from_json("body", "fields array<string>, items array<array<string>>").alias("r"))
    rows = parsed.select("source", F.explode(F.transform("r.items", lambda i: F.map_from_arrays("r.fields", i))).alias("m"))
    return rows.select("source", F.col("m")["event_id"].cast("long").alias("event_id"), F.col("m")["user_id"].cast("long").alias("user_id"), F.col("m")["value"].alias("value"))


def bars(ticks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, bar_us, open, high, low, close, n): prices of each key by bars of a width; of one moment the smaller id comes first."""
    at = F.struct("us", "event_id")
    return ticks.groupBy(*keys, (F.expr(f"us div {width}") * width).alias("bar_us")).agg(F.min_by("v", at).alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", at).alias("close"), F.count(F.lit(1)).alias("n"))


def _bars_sql(width: int) -> str:
    return f"""WITH {EV} SELECT object_id, us // {width} * {width} AS bar_us, CAST(arg_min(v, us * 10000000::HUGEINT + event_id) AS DOUBLE) AS "open", CAST(max(v) AS DOUBLE) AS high, CAST(min(v) AS DOUBLE) AS low, CAST(arg_max(v, us * 10000000::HUGEINT + event_id) AS DOUBLE) AS "close", count(*) AS n FROM ev GROUP BY 1, 2"""


def _doubles(df: DataFrame) -> DataFrame:
    return df.select("object_id", "bar_us", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], "n")


@query(_bars_sql(5 * MINUTE))
def minute_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of five minutes."""
    return _doubles(bars(events(spark, d), ["object_id"], 5 * MINUTE))


@query(_bars_sql(DAY))
def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of a day."""
    return _doubles(bars(events(spark, d), ["object_id"], DAY))


@query(f"""WITH {EV}, r AS (SELECT day AS run_id, object_id, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM ev GROUP BY 1, 2)
SELECT run_id, object_id, CASE WHEN run_id <= {AS_OF // DAY} THEN n ELSE n + 1000 END AS n FROM r""")
def save_run(spark: SparkSession, d: str) -> DataFrame:
    """K4: a run is inserted once: one that is saved again with other numbers stays as it was; read back in its slim form."""
    path = files.scratch(spark, "runs")
    runs = events(spark, d).groupBy(F.col("day").alias("run_id"), "object_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total"))

    def save(rows: DataFrame, known: DataFrame | None) -> None:
        new = rows if known is None else rows.join(known.select("run_id").distinct(), "run_id", "left_anti")
        new.write.mode("append").partitionBy("run_id").parquet(path)

    save(runs.where(F.col("run_id") <= AS_OF // DAY), None)
    save(runs.withColumn("n", F.col("n") + 1000), spark.read.parquet(path))
    return spark.read.parquet(path).select(F.col("run_id").cast("long").alias("run_id"), "object_id", "n")


@query(f"WITH {EV} SELECT source, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total, max(us) AS last_us FROM ev GROUP BY 1")
def raw_archive(spark: SparkSession, d: str) -> DataFrame:
    """K6: what came in, kept as compressed JSON by source, and read again."""
    path = files.scratch(spark, "archive")
    events(spark, d).select("source", "event_id", "us", F.col("v").cast("string").alias("v")).write.partitionBy("source").json(path, compression="gzip")
    back = spark.read.schema("event_id long, us long, v string, source string").json(path)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("total"), F.max("us").alias("last_us"))


EARLY, ACTIVE = ("information_new", "warming"), ("accelerating", "high_heat", "warming")
STAGES_SQL = f"st AS ({people.SQL['stage_cascade']}), ps AS (SELECT object_id, count(*) AS posts FROM (WITH {EV} SELECT * FROM ev) GROUP BY 1)"


def staged(spark: SparkSession, d: str) -> DataFrame:
    posts = events(spark, d).groupBy("object_id").agg(F.count(F.lit(1)).alias("posts"))
    return people.stage_cascade(spark, d).join(posts, "object_id")


def _in(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(f"WITH {STAGES_SQL} SELECT object_id, stage, posts, row_number() OVER (ORDER BY posts DESC, object_id) AS place FROM st JOIN ps USING (object_id) WHERE stage IN ({_in(EARLY)}) AND contains('object ' || object_id, 't 1') ORDER BY posts DESC, object_id LIMIT 50")
def client_search(spark: SparkSession, d: str) -> DataFrame:
    """P10: objects of the early group whose name holds a text, in rank order, then by id; a page shows fifty."""
    found = staged(spark, d).where(F.col("stage").isin(*EARLY) & F.concat(F.lit("object "), F.col("object_id").cast("string")).contains("t 1"))
    # One page, so one window over it is fine.
    return found.orderBy(F.desc("posts"), "object_id").limit(50).select("object_id", "stage", "posts", F.row_number().over(Window.orderBy(F.desc("posts"), "object_id")).cast("long").alias("place"))


@query(f"WITH {STAGES_SQL} SELECT object_id, stage, posts FROM st JOIN ps USING (object_id) WHERE stage IN ({_in(ACTIVE)}) ORDER BY posts DESC, object_id LIMIT 6")
def sector_cards(spark: SparkSession, d: str) -> DataFrame:
    """The six cards of active groups; the number is the page's."""
    return staged(spark, d).where(F.col("stage").isin(*ACTIVE)).orderBy(F.desc("posts"), "object_id").limit(6)


@query(f"""WITH {EV}, m AS (SELECT object_id, max(day) AS until_day FROM ev WHERE source = 'error' GROUP BY 1) SELECT ev.object_id, day, count(*) AS n FROM ev JOIN m ON ev.object_id = m.object_id WHERE day <= until_day GROUP BY 1, 2""")
def chart_to_metric_day(spark: SparkSession, d: str) -> DataFrame:
    """An object's daily series up to the day of its last metric (here: its last error)."""
    e = events(spark, d)
    until = e.where("source = 'error'").groupBy("object_id").agg(F.max("day").alias("until_day"))
    return e.join(until, "object_id").where("day <= until_day").groupBy("object_id", "day").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, k AS (SELECT source, object_id, count(*) AS n FROM ev WHERE day < {AS_OF // DAY} AND day >= {AS_OF // DAY - 20} AND obs_us <= {AS_OF} GROUP BY 1, 2), s AS ({storage.SQL["eligibility_staleness"]})
SELECT s.source, count(*) AS objects, median(coalesce(n, 0)) AS history20 FROM s LEFT JOIN k ON k.source = s.source AND k.object_id = s.object_id WHERE NOT stale GROUP BY 1""")
def kpi_history(spark: SparkSession, d: str) -> DataFrame:
    """The median of twenty days' observations over evidence that isn't stale."""
    e = events(spark, d).where((F.col("day") < AS_OF // DAY) & (F.col("day") >= AS_OF // DAY - 20) & (F.col("obs_us") <= AS_OF))
    k = e.groupBy("source", "object_id").agg(F.count(F.lit(1)).alias("n"))
    fresh = storage.eligibility_staleness(spark, d).where("not stale").select("source", "object_id")
    return fresh.join(k, ["source", "object_id"], "left").groupBy("source").agg(F.count(F.lit(1)).alias("objects"), F.median(F.coalesce("n", F.lit(0))).alias("history20"))


#: Which phase of the day each source is collected in.
COLLECTED = {"click": "intraday", "view": "intraday", "purchase": "postmarket", "error": "premarket"}
_COLLECTED_SQL = ", ".join(f"('{s}', '{p}')" for s, p in COLLECTED.items())


@query(f"""WITH {EV}, {market.CAL_SQL}, due(source, stage) AS (VALUES {_COLLECTED_SQL}), m AS (SELECT source, CAST(make_timestamp(us) AS DATE) AS day, (us % {DAY}) // 60000000 AS minute FROM ev),
p AS (SELECT source, CASE WHEN NOT is_open OR minute < 570 THEN 'premarket' WHEN minute < 900 THEN 'intraday' ELSE 'postmarket' END AS phase FROM m JOIN cal USING (day)) SELECT p.source, phase, count(*) AS n FROM p JOIN due ON p.source = due.source AND phase = stage GROUP BY 1, 2""")
def market_stage(spark: SparkSession, d: str) -> DataFrame:
    """What comes in the phase of the day that its source is collected in."""
    m = events(spark, d).select("source", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("day"), F.expr(f"(us % {DAY}) div {MINUTE}").alias("minute"))
    m = m.join(market.days(spark), "day").select("source", calendar.phase(F.col("is_open"), F.col("minute")).alias("phase"))
    due = F.create_map(*[F.lit(x) for pair in COLLECTED.items() for x in pair])
    return m.where(F.try_element_at(due, F.col("source")) == F.col("phase")).groupBy("source", "phase").agg(F.count(F.lit(1)).alias("n"))


#: Values that must not be shown, longest first, so that none is left in part.
HIDDEN = ("token-4711-long", "token-4711", "key 99")


def masked(text: Column, hidden: tuple[str, ...] = HIDDEN, mark: str = "***") -> Column:
    for value in sorted(hidden, key=len, reverse=True):
        text = F.replace(text, F.lit(value), F.lit(mark))
    return text


_MESSAGE = "'GET /' || source || CASE event_id % 3 WHEN 0 THEN '?t=token-4711-long' WHEN 1 THEN '?t=token-4711&k=key 99' ELSE '' END || ' by ' || user_id"


@query(f"WITH {EV} SELECT event_id, replace(replace(replace({_MESSAGE}, 'token-4711-long', '***'), 'token-4711', '***'), 'key 99', '***') AS message FROM ev")
def masked_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages without the values that must not be shown."""
    tail = F.when(F.col("event_id") % 3 == 0, "?t=token-4711-long").when(F.col("event_id") % 3 == 1, "?t=token-4711&k=key 99").otherwise("")
    return events(spark, d).select("event_id", masked(F.concat(F.lit("GET /"), "source", tail, F.lit(" by "), F.col("user_id").cast("string"))).alias("message"))


@query(f"""WITH {EV}, o AS (SELECT object_id, us // {HOUR} AS tick, count(*) AS n FROM ev GROUP BY 1, 2), t AS (SELECT object_id, min(tick) AS onset FROM o WHERE n >= 2 GROUP BY 1), {market.PAIR_SQL.removeprefix(f"{EV}, ")}
SELECT a, b, n, families, CAST((tb.onset - ta.onset) * 60 AS BIGINT) AS lag_minutes, CASE WHEN tb.onset >= ta.onset THEN a WHEN tb.onset < ta.onset THEN b END AS first_seen FROM pr LEFT JOIN t ta ON ta.object_id = a LEFT JOIN t tb ON tb.object_id = b""")
def coattention(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with the lag between their onsets (here: the first hour of two posts) and which of the two began."""
    hours = events(spark, d).groupBy("object_id", F.expr(f"us div {HOUR}").alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    onset = hours.where("n >= 2").groupBy("object_id").agg(F.min("tick").alias("onset"))
    return graph.with_onset_lag(market.pairs_of(spark, d, 30), onset, "object_id", "onset", 60)


def _fanned(spark: SparkSession, d: str, results: str, files_: int = 4, every: str | None = None, name: str | None = None):
    """The events as a stream of a file a batch, appended and counted by source as they come. `every`: run at that interval until nothing is left."""
    inbox = files.scratch(spark, "fan-inbox")
    rows = events(spark, d).select("event_id", "source", "us")
    rows.repartitionByRange(files_, "event_id").write.parquet(inbox)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    query = windows.fanned_out(stream, files.scratch(spark, "fan-raw"), lambda b: b.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us")), results, files.scratch(spark, "fan-log"), every, name)
    if every:
        query.processAllAvailable()
        query.stop()
    else:
        query.awaitTermination()
    return query


@query(f"WITH {EV} SELECT source, count(*) AS n, max(us) AS last_us FROM ev GROUP BY 1")
def stream_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Batches appended first and analysed then; the analyses of all batches put together."""
    results = files.scratch(spark, "fan-results")
    _fanned(spark, d, results)
    return spark.read.parquet(results).groupBy("source").agg(F.sum("n").alias("n"), F.max("last_us").alias("last_us"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows FROM events")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """A query that runs every tenth of a second, a file a batch; a listener keeps what all its batches report: all rows, each once."""
    return reported(spark, d, 12).agg(F.sum("rows").alias("rows"))


def reported(spark: SparkSession, d: str, batches: int) -> DataFrame:
    kept, name = files.scratch(spark, "progress"), f"fanned-{uuid.uuid4().hex}"
    listener = windows.Progress(spark, kept, name)
    spark.streams.addListener(listener)
    try:
        _fanned(spark, d, files.scratch(spark, "fan-results"), batches, "100 milliseconds", name)
        # Reports reach the listener after the batches' end.
        if not listener.done.wait(60):
            raise TimeoutError("the query's end was not reported")
    finally:
        spark.streams.removeListener(listener)
    return windows.progress(spark, kept)


@query(f"""SELECT s_suppkey AS source, s_suppkey % 7 AS failures, CAST({AS_OF} + (s_suppkey % 5 + 1) * {3 * MINUTE} * least(power(2, s_suppkey % 7), 8) AS BIGINT) AS next_us FROM supplier""")
def source_backoff(spark: SparkSession, d: str) -> DataFrame:
    """M2: when each source is asked again: its interval, doubled for each failure in a row, eight times at most."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % 7).alias("failures"), ((F.col("s_suppkey") % 5 + 1) * 3 * MINUTE).alias("interval"))
    return s.select("source", "failures", (F.lit(AS_OF) + F.col("interval") * F.least(F.pow(F.lit(2), "failures"), F.lit(8))).cast("long").alias("next_us"))


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def backup(spark: SparkSession, d: str) -> DataFrame:
    """K9: a table copied while it is in use, read back from the copy."""
    path = files.scratch(spark, "backup")
    table(spark, d, "orders").write.parquet(path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
