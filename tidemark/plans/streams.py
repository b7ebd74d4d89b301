"""Queries over streams with state of their own, paged sources and watched files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import episodes as E
from tidemark.streaming import windows

from .base import DAY, HOUR, MINUTE, micros, registered, table

QUERIES, SQL, query = registered()

_NTZ = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(timestamp_micros({}) as timestamp_ntz))"


#: Rows of a file that arrives.
FILE_ROWS = 500_000


def arriving(spark: SparkSession, d: str, batches: int) -> DataFrame:
    """The events in order of time, as a stream of a file set a batch: each has as many files as the largest needs, some of them empty."""
    inbox = files.scratch(spark, "arriving")
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    span = e.agg(F.min(micros("ts")).alias("a"), F.max(micros("ts")).alias("b")).first()
    width = (span["b"] - span["a"]) // batches + 1 if span["a"] is not None else 1
    batch = F.expr(f"({_us('ts')} - {span['a'] or 0}) div {width}")
    held = {r["k"]: -(-r["n"] // FILE_ROWS) for r in e.groupBy(batch.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect() if r["k"] is not None}
    most = max(held.values(), default=1)
    for k in range(batches):
        own = held.get(k, 1)
        e.where(batch == k).repartition(own).write.mode("append").parquet(inbox)
        for _ in range(most - own):
            e.where("false").coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(windows.EVENTS).option("maxFilesPerTrigger", most).parquet(inbox)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def _us(ts: str) -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))"


@query(f"""WITH e AS (SELECT user_id AS key, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS member FROM events),
c AS (SELECT *, sum(CASE WHEN us - before <= {DAY} THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY us) AS nth FROM (SELECT *, lag(us) OVER (PARTITION BY key ORDER BY us) AS before FROM e)),
s AS (SELECT key, nth, min(us) AS start_us, max(us) AS end_us, count(*) AS n, count(DISTINCT member) AS members FROM c GROUP BY 1, 2),
m AS (SELECT DISTINCT key, nth, member FROM c), r AS (SELECT a.key, a.nth, count(*) AS retained FROM m a JOIN m b ON a.key = b.key AND a.member = b.member AND a.nth = b.nth + 1 GROUP BY 1, 2)
SELECT s.key, start_us, end_us, n, members, members - coalesce(retained, 0) AS entered, coalesce(lag(members) OVER (PARTITION BY s.key ORDER BY s.nth), 0) - coalesce(retained, 0) AS departed, coalesce(retained, 0) AS retained, s.nth > 1 AS comparable
FROM s LEFT JOIN r ON r.key = s.key AND r.nth = s.nth QUALIFY end_us + {DAY} < (SELECT max(epoch_us(ts)) - {HOUR} FROM events) // 1000 * 1000""")
def stream_episodes(spark: SparkSession, d: str) -> DataFrame:
    """M9: episodes of each actor over batches, closed a day after their last row by timers, with the pool of objects against the one before."""
    stream = arriving(spark, d, 5).withColumn("member", F.get_json_object("props", "$.k"))
    out = windows.finished(E.episodes(stream, "user_id", "ts", "member", DAY), "episodes")
    return out.withColumns({n: F.expr(_NTZ.format(n)) for n in ("start_us", "end_us")})


_RECORD = "struct(event_id, event_type AS source, cast(value AS decimal(18,2)) AS v)"


def _written_pages(spark: SparkSession, pages: DataFrame) -> str:
    """(token, records, next) as one file a page."""
    folder = files.scratch(spark, "pages")
    pages.select("token", F.to_json(F.struct(F.coalesce("records", F.array()).alias("records"), "next")).alias("value")).repartition("token").write.partitionBy("token").text(folder)
    return folder


def one_chain(spark: SparkSession, d: str, size: int) -> str:
    """All events as one chain of pages of `size` event numbers; a number range without events is a page without records."""
    e = table(spark, d, "events").withColumn("page", F.expr(f"event_id div {size}"))
    ends = e.agg(F.min("page").alias("a"), F.max("page").alias("b")).first()
    records = e.groupBy("page").agg(F.sort_array(F.collect_list(F.expr(_RECORD))).alias("records"))
    pages = spark.range(ends["a"] or 0, (ends["b"] or 0) + 1).withColumnRenamed("id", "page").join(records, "page", "left")
    after = F.when(F.col("page") < F.lit(ends["b"] or 0), F.concat(F.lit("p."), (F.col("page") + 1).cast("string")))
    return _written_pages(spark, pages.select(F.concat(F.lit("p."), F.col("page").cast("string")).alias("token"), "records", after.alias("next")))


def chains_by_source(spark: SparkSession, d: str, size: int) -> str:
    """The events of each source as a chain of its own."""
    e = table(spark, d, "events").withColumn("page", F.expr(f"event_id div {size}"))
    pages = e.groupBy("event_type", "page").agg(F.sort_array(F.collect_list(F.expr(_RECORD))).alias("records"))
    token = F.concat("event_type", F.lit("."), F.col("page").cast("string"))
    heads = e.select("event_type", "page").distinct().select("event_type", "page", token.alias("token"), F.lead(token).over(Window.partitionBy("event_type").orderBy("page")).alias("next"))
    return _written_pages(spark, pages.join(heads, ["event_type", "page"]))


def _first_tokens(spark: SparkSession, d: str, size: int) -> dict[str, str]:
    """One row a source: there are few."""
    rows = table(spark, d, "events").groupBy("event_type").agg(F.min(F.expr(f"event_id div {size}")).alias("page")).collect()
    return {r["event_type"]: f"{r['event_type']}.{r['page']}" for r in rows}


_PAGE = 500


@query("SELECT event_type AS source, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, true AS complete FROM events GROUP BY 1")
def paged_source(spark: SparkSession, d: str) -> DataFrame:
    """A source followed from token to token to its end, eight pages a batch and more once many are read, the cursor pending until the batch is stored."""
    from tidemark.sources import paged

    out, first = files.scratch(spark, "paged-table"), table(spark, d, "events").agg(F.min(F.expr(f"event_id div {_PAGE}"))).first()[0]
    paged.drained(paged.stream(spark, one_chain(spark, d, _PAGE), f"p.{first or 0}"), out, files.scratch(spark, "paged-log"))
    rows = spark.read.parquet(out)
    complete = rows.agg(F.bool_or("last")).first()[0]
    r = F.from_json("record", "event_id long, source string, v decimal(18,2)")
    return rows.where("record is not null").select(r.alias("r")).groupBy("r.source").agg(F.count(F.lit(1)).alias("n"), F.sum("r.v").cast("double").alias("total")).withColumn("complete", F.lit(bool(complete)))


@query(f"""WITH e AS (SELECT event_type AS search, event_id // {_PAGE} AS page FROM events), p AS (SELECT search, page, count(*) AS n, row_number() OVER (PARTITION BY search ORDER BY page) AS nth, count(*) OVER (PARTITION BY search) AS pages FROM e GROUP BY 1, 2)
SELECT search, count(*) AS pages, CAST(sum(n) AS BIGINT) AS records, max(pages) <= 3 AS complete FROM p WHERE nth <= 3 GROUP BY 1""")
def paged_searches(spark: SparkSession, d: str) -> DataFrame:
    """Searches of three pages at most, each source a search, and whether that was all; three is the feature's own bound."""
    from tidemark.sources import paged

    return paged.coverage(paged.searches(spark, chains_by_source(spark, d, _PAGE), _first_tokens(spark, d, _PAGE), 3))


@query("""WITH p AS (SELECT *, event_id % 4 AS file FROM events)
SELECT poll, files, CAST(n AS BIGINT) AS n FROM (SELECT 1 AS poll, 2 AS files, count(*) FILTER (WHERE file < 2) AS n FROM p UNION ALL SELECT 2, 2, count(*) FILTER (WHERE file >= 2) FROM p)""")
def fingerprint_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A folder polled three times: two files; one rewritten under its name with more rows and one new; the same bytes again, which are not read."""
    folder, out, ledger = (files.scratch(spark, n) for n in ("watched", "watched-rows", "watched-ledger"))
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("source"), (F.col("event_id") % 4).alias("file"))

    def put(name: str, rows: DataFrame) -> None:
        """One file of that name."""
        files.put_file(rows.select(F.to_json(F.struct("event_id", "source")).alias("value")), f"{folder}/{name}")

    def look(number: int) -> None:
        files.poll(spark, folder, out, ledger, number, "event_id long, source string", "event_id")

    put("a.jsonl", e.where("file = 0"))
    put("b.jsonl", e.where("file = 1"))
    look(1)
    put("a.jsonl", e.where("file in (0, 2)"))
    put("c.jsonl", e.where("file = 3"))
    look(2)
    put("b.jsonl", e.where("file = 1"))
    look(3)
    rows = spark.read.parquet(out).groupBy("poll").agg(F.count(F.lit(1)).alias("n"))
    seen = spark.read.parquet(ledger).groupBy("poll").agg(F.count(F.lit(1)).alias("files"))
    return seen.join(rows, "poll", "full").select(F.col("poll").cast("int").alias("poll"), F.col("files").cast("int").alias("files"), F.coalesce("n", F.lit(0)).alias("n"))
