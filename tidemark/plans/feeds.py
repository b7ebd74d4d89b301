"""Sources, sinks, streams, and small relational forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ranking
from tidemark.sources import files
from tidemark.streaming import windows

from .base import AS_OF, DAY, EV, events, registered, table

QUERIES, SQL, query = registered()

CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_mktsegment", T.StringType())])
_CUST = "SELECT c_custkey, c_name, c_mktsegment FROM customer"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query(_CUST)
def csv_source(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV and read again."""
    path = files.scratch(spark, "csv")
    _customers(spark, d).write.csv(path, header=True, escape='"')
    return files.read_csv(spark, path, CUSTOMER)


@query(_CUST)
def jsonl_source(spark: SparkSession, d: str) -> DataFrame:
    """S3 K8: written as JSON lines and read again."""
    path = files.scratch(spark, "jsonl")
    _customers(spark, d).write.json(path)
    return files.read_json_lines(spark, path, CUSTOMER)


@query(_CUST)
def json_source(spark: SparkSession, d: str) -> DataFrame:
    """Files that hold one object with a list of records, a few hundred records a file."""
    path = files.scratch(spark, "json")
    whole = _customers(spark, d).groupBy(F.expr("c_custkey div 500").alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("records"))).alias("value"))
    whole.select("value", "part").repartition("part").write.partitionBy("part").text(path)
    return files.read_json(spark, f"{path}/*", CUSTOMER)


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def xml_source(spark: SparkSession, d: str) -> DataFrame:
    """Written as XML and read again by row tag."""
    path = files.scratch(spark, "xml")
    table(spark, d, "conversations").select("conv_id", "turn", "role", F.base64(F.encode("text", "UTF-8")).alias("body")).write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("body", T.StringType())])
    return files.read_xml(spark, path, "entry", schema).select("conv_id", "turn", "role", F.md5(F.unbase64("body")).alias("digest"))


def raw_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    return e.select(
        F.when(k % 3 != 0, F.concat(F.lit("r"), k.cast("string"))).otherwise(" ").alias("record_id"),
        F.when(k % 97 == 0, "gossip").otherwise("participation").alias("kind"),
        F.when(k % 5 == 0, "").otherwise(F.col("event_type")).alias("source"),
        F.get_json_object("props", "$.k").alias("object_id"),
        F.lit("").alias("objects"),
        F.when(k % 89 == 0, "2024-01-05 10:00:00").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))).alias("occurred_at"),
        F.when(k % 83 == 0, "[deleted]").otherwise(F.col("user_id").cast("string")).alias("entity_id"),
        F.lit("posts").alias("metric"),
        F.when(k % 79 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("value"),
        F.lit('{"a": "1"}').alias("extra"),
    )


@query("""SELECT coalesce(nullif(CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END, ''), 'local') AS source, count(*) AS n, count(*) FILTER (WHERE event_id % 3 <> 0) AS own_ids, count(DISTINCT json_extract_string(props, '$.k')) AS objects FROM events GROUP BY 1""")
def row_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows to records: blanks, defaults, maps, ids."""
    n = files.normalised(raw_rows(spark, d), "local")
    return n.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("record_id").startswith("r")).alias("own_ids"), F.count_distinct(F.map_keys("objects")[0]).alias("objects"))


@query("""WITH b AS (SELECT array_to_string(list_filter([CASE WHEN event_id % 97 = 0 THEN 'kind' END, CASE WHEN event_id % 89 = 0 THEN 'time' END, CASE WHEN event_id % 79 = 0 THEN 'value' END, CASE WHEN event_id % 83 = 0 AND event_id % 97 <> 0 THEN 'actor' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events) SELECT reasons, count(*) AS n FROM b GROUP BY 1""")
def validate_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Good rows and those set aside, with reasons."""
    good, bad = files.checked(files.normalised(raw_rows(spark, d), "local"))
    return good.select(F.lit("").alias("reasons")).unionByName(bad.select(F.array_join("reasons", ",").alias("reasons"))).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS own, CASE WHEN event_id % 5 = 0 THEN 'local' ELSE event_type END AS source, event_id, user_id, ts, value, props FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0 AND event_id % 79 <> 0)
SELECT source, count(DISTINCT coalesce(CAST(own AS VARCHAR), concat_ws('|', 'x', source, json_extract_string(props, '$.k'), strftime(ts, '%Y-%m-%dT%H:%M:%S'), user_id, value))) AS n FROM e GROUP BY 1""")
def dir_watch_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A watched folder, each file once, each record once."""
    folder, out = files.scratch(spark, "inbox"), files.scratch(spark, "records")
    raw = raw_rows(spark, d)
    raw.write.json(folder)
    raw.limit(100).write.mode("append").json(folder)
    windows.ingest(spark, folder, files.RECORD, out, "record_id")
    return spark.read.parquet(out).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS nodes, max(turn) AS depth, sum(length(text)) AS chars FROM conversations GROUP BY 1".replace("sum(length(text))", "CAST(sum(length(text)) AS BIGINT)"))
def comment_tree(spark: SparkSession, d: str) -> DataFrame:
    """A nested comment tree flattened by a recursive query."""
    c = table(spark, d, "conversations")
    c = c.select("conv_id", "turn", F.length("text").cast("long").alias("chars"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"))
    return spark.sql("""WITH RECURSIVE tree(conv_id, turn, depth, chars) AS (SELECT conv_id, turn, 0L, chars FROM {c} WHERE parent IS NULL
      UNION ALL SELECT c.conv_id, c.turn, t.depth + 1, c.chars FROM tree t JOIN {c} c ON c.conv_id = t.conv_id AND c.parent = t.turn)
      SELECT conv_id, count(*) AS nodes, max(depth) AS depth, sum(chars) AS chars FROM tree GROUP BY conv_id""", c=c)


@query("""SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS forecast_year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2""")
def unpivot_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Wide columns named by year made long again by their names."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    # As many columns as the table has years.
    years = sorted(r["y"] for r in o.select("y").distinct().collect())
    wide = o.groupBy("o_custkey").agg(*[F.sum(F.when(F.col("y") == y, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias(f"{y}_forecast") for y in years])
    long = wide.unpivot(["o_custkey"], [f"{y}_forecast" for y in years], "name", "value").where("value is not null")
    return long.select("o_custkey", F.regexp_extract("name", r"(\d{4})_forecast", 1).cast("int").alias("forecast_year"), "value")


@query("""SELECT kind, count(*) AS n, count(DISTINCT conv_id) AS convs FROM (SELECT 'question' AS kind, conv_id FROM conversations WHERE role = 'user' UNION ALL SELECT 'answer', conv_id FROM conversations WHERE role = 'assistant' UNION ALL SELECT 'actor', conv_id FROM (SELECT DISTINCT conv_id, role FROM conversations) UNION ALL SELECT 'coverage', conv_id FROM (SELECT DISTINCT conv_id FROM conversations)) GROUP BY 1""")
def multi_kind_source(spark: SparkSession, d: str) -> DataFrame:
    """One feed becomes records of several kinds."""
    c = table(spark, d, "conversations").select("conv_id", "role")
    kinds = F.array_compact(F.array(F.when(F.col("role") == "user", "question"), F.when(F.col("role") == "assistant", "answer")))
    out = c.select("conv_id", F.explode(kinds).alias("kind"))
    out = out.unionByName(c.distinct().select("conv_id", F.lit("actor").alias("kind"))).unionByName(c.select("conv_id").distinct().withColumn("kind", F.lit("coverage")))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("convs"))


_SEG = [("rings", "ring"), ("widgets", "widget"), ("red", "red"), ("small", "small")]


@query(f"WITH s(topic, word) AS (VALUES {', '.join(str(x) for x in _SEG)}) SELECT p_brand, topic, count(*) AS n, round(CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS revenue FROM part JOIN s ON list_contains(string_split(p_name, ' '), word) GROUP BY 1, 2")
def segment_match(spark: SparkSession, d: str) -> DataFrame:
    """Business segments linked to topics by the words of their names."""
    words = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    j = words.join(spark.createDataFrame(_SEG, "topic string, word string"), "word")
    return j.groupBy("p_brand", "topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double"), 2).alias("revenue"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events")
    return windows.event_stream(spark, f"{d}/events.parque[t]")


def _naive(df: DataFrame, *names: str) -> DataFrame:
    """Window bounds as microseconds: the stream's instants came from a naive clock read in the session's zone."""
    return df.withColumns({n: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({n} as timestamp_ntz))") for n in names})


_CLOSED = "<= (SELECT max(epoch_us(ts)) FROM events) - 3600000000"


@query(f"""SELECT (us // {DAY}) * {DAY} AS "start", (us // {DAY} + 1) * {DAY} AS "end", event_type, count(*) AS n, count(DISTINCT user_id) AS actors FROM (SELECT *, epoch_us(ts) AS us FROM events) WHERE (us // {DAY} + 1) * {DAY} {_CLOSED} GROUP BY 1, 2, 3""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """M5: days, put out when the watermark has passed them."""
    return _naive(windows.finished(windows.tumbling(_stream(spark, d), "1 day"), "tumbling"), "start", "end")


_H6 = 21_600_000_000


@query(f"""WITH e AS (SELECT event_type, epoch_us(ts) AS us FROM events), w AS (SELECT event_type, (us // {_H6} - k) * {_H6} AS s FROM e, range(4) r(k)) SELECT s AS "start", s + {4 * _H6} AS "end", event_type, count(*) AS n FROM w WHERE s + {4 * _H6} {_CLOSED} GROUP BY 1, 2, 3""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """M6: days that begin every six hours."""
    return _naive(windows.finished(windows.sliding(_stream(spark, d), "24 hours", "6 hours"), "sliding"), "start", "end")


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), m AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > {2 * _H6} THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)), r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY us) AS run FROM m)
SELECT min(us) AS "start", max(us) + {2 * _H6} AS "end", user_id, count(*) AS n FROM r GROUP BY user_id, run HAVING max(us) + {2 * _H6} {_CLOSED}""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    """M7: sessions of an actor, twelve hours apart at most."""
    return _naive(windows.finished(windows.sessions(_stream(spark, d), "12 hours"), "session"), "start", "end")


@query("SELECT user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS key FROM events GROUP BY 1")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """M8: each key once while the watermark holds it."""
    raw = spark.readStream.schema(windows.EVENTS).parquet(f"{d}/events.parque[t]")
    s = raw.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long")).alias("key")).withWatermark("ts", "60 days")
    return windows.finished(windows.deduplicated(s, "key"), "dedupe").select("key")


@query("SELECT user_id, min(epoch_us(ts)) AS first_us, count(*) AS n FROM events GROUP BY 1")
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """M9: state of each actor kept across batches; the last row of each is its state now."""
    raw = spark.readStream.schema(windows.EVENTS).parquet(f"{d}/events.parque[t]")
    s = windows.finished(windows.first_seen(raw.select("user_id", F.col("ts").cast("timestamp").alias("ts"))), "state")
    last = s.groupBy("user_id").agg(F.min("first_us").alias("first_us"), F.max("n").alias("n"))
    return last.withColumn("first_us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(timestamp_micros(first_us) as timestamp_ntz))"))


@query(f"WITH {EV} SELECT source, event_id, CAST(rn AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY v DESC, us, event_id) AS rn FROM ev) WHERE rn <= 25")
def ordered_topk(spark: SparkSession, d: str) -> DataFrame:
    """L1 L3: the 25 first of each source by value, time and id; the limit is the report's length."""
    w = Window.partitionBy("source").orderBy(F.desc("v"), "us", "event_id")
    return events(spark, d).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 25").select("source", "event_id", "place")


@query(f"WITH {EV}, k AS (SELECT object_id, source, count(*) AS n, max(us) AS last_us FROM ev GROUP BY 1, 2) SELECT object_id, source, n FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY (last_us >= {AS_OF}) DESC, (n >= 20) DESC, n DESC, source) AS rn FROM k) WHERE rn = 1")
def primary_pick(spark: SparkSession, d: str) -> DataFrame:
    """L2: the main evidence of an object: current first, then rich, then large."""
    k = events(spark, d).groupBy("object_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us"))
    order = [F.desc(F.col("last_us") >= AS_OF), F.desc(F.col("n") >= 20), F.desc("n"), F.col("source")]
    return k.withColumn("rn", F.row_number().over(Window.partitionBy("object_id").orderBy(*order))).where("rn = 1").select("object_id", "source", "n")


@query("SELECT o_orderkey, epoch_us(o_orderdate) AS us FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The newest twenty; the limit is the report's length."""
    from .base import micros

    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey", micros("o_orderdate").alias("us"))


@query("SELECT p_brand, p_type, max(p_partkey) FILTER (WHERE rn = 1) AS best FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rn FROM part) GROUP BY 1, 2")
def keep_best(spark: SparkSession, d: str) -> DataFrame:
    """Of duplicates the one of the best relation, then strength."""
    best = F.max_by("p_partkey", F.struct("p_size", "p_retailprice", F.negate("p_partkey")))
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(best.alias("best"))


@query("SELECT c_custkey FROM customer ORDER BY sha256('s2:' || c_custkey) LIMIT 50")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of fifty by hash, the same at every run."""
    return table(spark, d, "customer").select("c_custkey").orderBy(F.sha2(F.concat(F.lit("s2:"), F.col("c_custkey").cast("string")), 256)).limit(50)


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer), a AS (SELECT c_custkey, 'quota' AS route, rn FROM c WHERE rn <= 3), r AS (SELECT c_custkey, 'rest' AS route, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM c WHERE rn > 3)
SELECT c_custkey, route FROM a UNION ALL SELECT c_custkey, route FROM r WHERE rn <= 25""")
def quota_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Three of each nation, then the 25 best of the others; both numbers are the plan's quotas."""
    c = table(spark, d, "customer").withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")))
    rest = c.where("rn > 3").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)
    return c.where("rn <= 3").select("c_custkey", F.lit("quota").alias("route")).unionByName(rest.select("c_custkey", F.lit("rest").alias("route")))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(*) FILTER (WHERE json_extract_string(props, '$.missing') IS NULL) AS unknown FROM events GROUP BY 1")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """Fields of JSON text; a missing one is null."""
    p = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("m"))
    return p.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m").isNull()).alias("unknown"))


@query(f"WITH {EV}, l AS (SELECT user_id, list(object_id ORDER BY us, event_id) AS xs FROM ev GROUP BY 1) SELECT user_id, array_to_string(xs[1:8], ',') AS first_8, array_to_string(xs[-5:], ',') AS last_5, len(xs) AS n FROM l")
def array_slice(spark: SparkSession, d: str) -> DataFrame:
    """Heads and tails of traces: only their rows come together."""
    e = events(spark, d).select("user_id", "us", "event_id", "object_id")

    def end(n: int, name: str, *order) -> DataFrame:
        few = e.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("nth") <= n)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "object_id"))), lambda x: x["object_id"].cast("string"))
        return few.groupBy("user_id").agg(F.array_join(listed, ",").alias(name))

    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return end(8, "first_8", "us", "event_id").join(end(5, "last_5", F.desc("us"), F.desc("event_id")), "user_id").join(n, "user_id").select("user_id", "first_8", "last_5", "n")


@query(f"WITH {EV}, f AS (SELECT user_id, source, min(us) AS us FROM ev GROUP BY 1, 2) SELECT user_id, string_agg(source, ',' ORDER BY us, source) AS sources FROM f GROUP BY 1")
def distinct_order(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values in the order they first came."""
    first = events(spark, d).groupBy("user_id", "source").agg(F.min("us").alias("us"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "source"))), lambda x: x["source"]), ",").alias("sources"))


@query(f"WITH {EV}, s AS (SELECT DISTINCT object_id, source FROM ev) SELECT a.source AS a, b.source AS b, count(*) AS objects FROM s a JOIN s b ON a.object_id = b.object_id AND a.source < b.source GROUP BY 1, 2")
def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within a small set, by object."""
    s = events(spark, d).groupBy("object_id").agg(F.array_sort(F.collect_set("source")).alias("s"))
    both = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return s.select(F.explode(both).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("objects"))


@query(f"WITH {EV} SELECT object_id, source, count(*) AS f1, CAST(sum(v) AS DOUBLE) AS f2 FROM ev GROUP BY 1, 2")
def panel_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A panel replaced by partition and loaded again."""
    path = files.scratch(spark, "panel")
    p = events(spark, d).groupBy("object_id", "source").agg(F.count(F.lit(1)).alias("f1"), F.sum("v").cast("double").alias("f2"))
    p.withColumn("f1", F.lit(0).cast("long")).where("source = 'view'").write.partitionBy("source").parquet(path)
    p.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    return spark.read.parquet(path).select("object_id", F.col("source").cast("string").alias("source"), "f1", "f2")


@query("SELECT c_nationkey, c_custkey, round(peers_sum / peers, 8) AS peer_mean FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) - 1 AS peers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) OVER (PARTITION BY c_nationkey) - CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS peers_sum FROM customer) WHERE peers >= 3")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """The mean of a row's peers without itself, by a window sum rather than a self-join."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("v"))
    return ranking.leave_one_out(c, "c_nationkey", "v", 3).where("peers >= 3").select("c_nationkey", "c_custkey", F.round("peer_mean", 8).alias("peer_mean"))
