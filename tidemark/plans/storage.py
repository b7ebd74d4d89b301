"""Scans, versions, keys and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import last_by
from tidemark.operators import bitemporal as B
from tidemark.operators import patches as P

from .base import AS_OF, DAY, EV, HOUR, MINUTE, events, micros, registered, table

QUERIES, SQL, query = registered()


@query(f"WITH {EV} SELECT event_id, us, obs_us, source, object_id FROM ev WHERE obs_us <= {AS_OF} AND us >= {AS_OF - 3 * DAY} AND us < {AS_OF} AND source IN ('view','click')")
def asof_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows known at a moment, of some kinds, in a half-open interval."""
    return B.as_of(events(spark, d).where(F.col("source").isin("view", "click")), AS_OF, AS_OF - 3 * DAY, AS_OF).select("event_id", "us", "obs_us", "source", "object_id")


@query("""SELECT o_custkey AS id, o_orderkey AS version_id, o_orderstatus AS status, epoch_us(o_orderdate) AS known_us FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30') WHERE rn = 1""")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """The version of each object that was known at a date; later insertions win ties."""
    o = table(spark, d, "orders").where("o_orderdate <= timestamp_ntz'1998-06-30 00:00:00'")
    v = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderstatus").alias("status"), micros("o_orderdate").alias("known_us"))
    return B.latest(v, ["id"], F.col("known_us"), F.col("version_id")).select("id", "version_id", "status", "known_us")


EDGES_SQL = """edges AS (SELECT p_brand AS topic, p_partkey AS symbol, (p_partkey % 50) * 10 AS effective_from,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_partkey % 50) * 10 + p_size * 5 END AS effective_to, p_partkey % 17 = 0 AS revoked, p_type, p_size, p_retailprice FROM part)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("p_partkey") % 50) * 10
    return table(spark, d, "part").select(
        F.col("p_brand").alias("topic"), F.col("p_partkey").alias("symbol"), start.alias("effective_from"), F.when(F.col("p_size") % 3 != 0, start + F.col("p_size") * 5).alias("effective_to"), (F.col("p_partkey") % 17 == 0).alias("revoked"), "p_type", "p_size", "p_retailprice"
    )


@query(f"WITH {EDGES_SQL} SELECT topic, symbol, effective_from, effective_to FROM edges WHERE effective_from <= 250 AND (effective_to IS NULL OR effective_to > 250) AND NOT revoked")
def effective_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that hold at a moment, half-open and not revoked."""
    return B.effective(edges(spark, d), 250).select("topic", "symbol", "effective_from", "effective_to")


@query(f"""WITH {EV}, objects AS (SELECT event_id, 'k' || object_id AS object_id, 'explicit' AS role FROM ev UNION ALL SELECT event_id, 'u' || (user_id % 10), 'context' FROM ev)
SELECT object_id, role, count(*) AS n, count(DISTINCT source) AS n_sources FROM objects JOIN ev USING (event_id) GROUP BY object_id, role""".replace("objects JOIN ev USING (event_id) GROUP BY object_id, role", "(SELECT o.object_id, o.role, e.source FROM objects o JOIN ev e ON o.event_id = e.event_id) GROUP BY object_id, role"))
def exploded_bridge(spark: SparkSession, d: str) -> DataFrame:
    """A map of objects on each record, exploded to (object, role, record) rows."""
    e = events(spark, d)
    m = F.create_map(F.concat(F.lit("k"), F.col("object_id").cast("string")), F.lit("explicit"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")), F.lit("context"))
    return e.select("source", F.explode(m).alias("object_id", "role")).groupBy("object_id", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"))


@query(f"""WITH {EV}, ranked AS (SELECT *, row_number() OVER (PARTITION BY object_id, source ORDER BY us, event_id) a, row_number() OVER (PARTITION BY object_id, source ORDER BY us DESC, event_id DESC) z FROM ev WHERE obs_us <= {AS_OF}),
r AS (SELECT object_id, max(CASE WHEN z = 1 THEN v END) AS last_v, max(CASE WHEN a = 1 THEN v END) AS first_v FROM ranked GROUP BY object_id)
SELECT c.object_id, c.n, c.first_us, CAST(r.first_v AS DOUBLE) AS first_v, CAST(r.last_v AS DOUBLE) AS last_v FROM (SELECT object_id, count(*) n, min(us) first_us FROM ev WHERE obs_us <= {AS_OF} GROUP BY object_id) c LEFT JOIN r USING (object_id)""")
def candidate_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by object, with the highest first and last values of its series."""
    e = B.as_of(events(spark, d), AS_OF)
    # The ends of each series are aggregates: no window, and rows are combined before the shuffle.
    ends = e.groupBy("object_id", "source").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.min_by("v", F.struct("us", "event_id")).alias("first_v"), F.max_by("v", F.struct("us", "event_id")).alias("last_v"))
    return ends.groupBy("object_id").agg(F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("first_v").cast("double").alias("first_v"), F.max("last_v").cast("double").alias("last_v"))


@query(f"WITH {EV} SELECT source, object_id % 10 AS metric, count(*) AS n, count(DISTINCT user_id) AS n_actors, count(DISTINCT object_id) AS n_objects, count(DISTINCT day) AS n_days, min(us) AS first_us, max(us) AS last_us FROM ev GROUP BY 1, 2")
def capability_matrix(spark: SparkSession, d: str) -> DataFrame:
    """What each source delivers: rows, actors, objects, days, first and last time."""
    return events(spark, d).groupBy("source", (F.col("object_id") % 10).alias("metric")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_actors"), F.countDistinct("object_id").alias("n_objects"), F.countDistinct("day").alias("n_days"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )


@query(f"WITH {EV} SELECT source AS kind, count(*) AS n, min(us) AS lo, max(us) AS hi FROM ev GROUP BY 1 UNION ALL SELECT 'documents', count(*), min(doc_id), max(doc_id) FROM documents")
def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows and range by kind."""
    stats = [F.count(F.lit(1)).alias("n")]
    one = events(spark, d).groupBy(F.col("source").alias("kind")).agg(*stats, F.min("us").alias("lo"), F.max("us").alias("hi"))
    return one.unionByName(table(spark, d, "documents").agg(*stats, F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).withColumn("kind", F.lit("documents")))


@query("""WITH h AS (SELECT doc_id, sha256(regexp_replace(lower(text), '\\s+', '', 'g')) AS key FROM documents), old AS (SELECT key FROM h WHERE doc_id % 10 = 0)
SELECT key, min(doc_id) AS doc_id FROM h WHERE doc_id % 10 <> 0 AND key NOT IN (SELECT key FROM old) GROUP BY key""")
def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Appends keep the first row of a key and skip keys that are stored."""
    h = table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace(F.lower("text"), r"\s+", ""), 256).alias("key"))
    return B.first_wins(h.where("doc_id % 10 <> 0"), h.where("doc_id % 10 = 0"), "key", "doc_id").select("key", "doc_id")


@query(f"WITH {EV} SELECT source, count(*) AS n, min(us) AS first_us FROM ev WHERE NOT (source = 'view' AND us < {AS_OF - 5 * DAY}) GROUP BY source")
def retention_prune(spark: SparkSession, d: str) -> DataFrame:
    """Old rows of one kind are dropped."""
    return B.pruned(events(spark, d), F.col("source") == "view", "us", AS_OF - 5 * DAY).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"))


@query("""SELECT DISTINCT o_custkey AS member, true AS revoked FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')""")
def vanished_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of an earlier snapshot that the later one lacks get a revoking version."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "member")
    before = o.where("o_orderdate < timestamp_ntz'1996-01-01 00:00:00'").select("member").distinct()
    return B.vanished(before, o.where("o_orderdate >= timestamp_ntz'1998-01-01 00:00:00'"), "member").withColumn("revoked", F.lit(True))


@query("""WITH v AS (SELECT o_custkey AS id, o_orderstatus AS status, o_orderpriority AS priority, (epoch_us(o_orderdate) // 1000000) * 10000000 + o_orderkey AS seq FROM orders),
c AS (SELECT *, lag(status) OVER w AS s0, lag(priority) OVER w AS p0, row_number() OVER w AS rn FROM v WINDOW w AS (PARTITION BY id ORDER BY seq))
SELECT id, status, priority, seq FROM c WHERE rn = 1 OR status <> s0 OR priority <> p0""")
def changed_versions(spark: SparkSession, d: str) -> DataFrame:
    """K2 K3: a version that changes nothing isn't stored."""
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.floor(micros("o_orderdate") / 1_000_000) * 10_000_000 + F.col("o_orderkey")).alias("seq"))
    return B.changed_versions(v, ["id"], ["status", "priority"], "seq")


@query("SELECT doc_id, arg_max(quality, seq) AS quality, arg_max(toxic, seq) AS toxic, count(*) AS versions FROM (SELECT doc_id, quality, toxic, 0 AS seq FROM labels UNION ALL SELECT doc_id, 1 - quality, toxic, 1 FROM labels WHERE doc_id % 5 = 0) GROUP BY doc_id")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Replace by key, the last write stays."""
    x = table(spark, d, "labels").withColumn("seq", F.lit(0))
    y = x.where("doc_id % 5 = 0").withColumn("quality", 1 - F.col("quality")).withColumn("seq", F.lit(1))
    return x.unionByName(y).groupBy("doc_id").agg(F.max_by("quality", "seq").alias("quality"), F.max_by("toxic", "seq").alias("toxic"), F.count(F.lit(1)).alias("versions"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'keep' WHEN toxic = 1 THEN 'reject' ELSE 'watch' END AS decision FROM labels UNION ALL SELECT doc_id + 1000000, 'keep' FROM labels WHERE doc_id % 7 = 0)
SELECT decision, count(*) AS n, min(doc_id) AS first_id FROM f WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY decision""")
def feedback_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Feedback counts only for candidates of the run."""
    x = table(spark, d, "labels")
    f = x.select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "keep").when(F.col("toxic") == 1, "reject").otherwise("watch").alias("decision"))
    f = f.unionByName(x.where("doc_id % 7 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("keep").alias("decision")))
    return f.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi").groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""WITH tasks AS (SELECT c_custkey AS object_id, c_custkey % 3 AS failures, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {AS_OF} - (c_custkey % 100) * {HOUR} END AS last_success FROM customer WHERE c_custkey % 2 = 0),
q AS (SELECT c.c_custkey AS object_id, t.last_success, coalesce(t.failures, 0) AS failures, coalesce(t.last_success, 0) + CASE WHEN coalesce(t.failures, 0) > 0 THEN 300000000 ELSE {24 * HOUR} END AS next_due FROM customer c LEFT JOIN tasks t ON c.c_custkey = t.object_id)
SELECT CAST(row_number() OVER (ORDER BY coalesce(last_success, 0), object_id) AS BIGINT) AS place, object_id, next_due, CAST(failures AS BIGINT) AS failures FROM q WHERE next_due <= {AS_OF} ORDER BY place LIMIT 200""")
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    """Due work, the longest unserved first; a failure is due again soon."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("object_id"))
    t = c.where("object_id % 2 = 0").select("object_id", (F.col("object_id") % 3).alias("failures"), F.when(F.col("object_id") % 4 != 0, F.lit(AS_OF) - (F.col("object_id") % 100) * HOUR).alias("last_success"))
    q = c.join(t, "object_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)).cast("long"))
    q = q.withColumn("next_due", F.coalesce("last_success", F.lit(0)) + F.when(F.col("failures") > 0, 300_000_000).otherwise(24 * HOUR)).where(F.col("next_due") <= AS_OF)
    # The limit is the queue's batch size; places are counted over that batch only.
    top = q.orderBy(F.coalesce("last_success", F.lit(0)), "object_id").limit(200)
    return top.select(F.row_number().over(last_by([], F.coalesce("last_success", F.lit(0)), F.col("object_id"))).cast("long").alias("place"), "object_id", "next_due", "failures")


@query(f"WITH {EV} SELECT source, day, count(*) AS n, count(*) FILTER (WHERE obs_us // {DAY} > day) AS late FROM ev WHERE day > {AS_OF // DAY - 8} AND day <= {AS_OF // DAY} GROUP BY 1, 2")
def watermark_increment(spark: SparkSession, d: str) -> DataFrame:
    """Day by day after a stored watermark, eight days a call at most, with what came late."""
    e = events(spark, d).where((F.col("day") > AS_OF // DAY - 8) & (F.col("day") <= AS_OF // DAY))
    return e.groupBy("source", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.floor(F.col("obs_us") / DAY) > F.col("day")).alias("late"))


@query(f"""WITH {EV}, s AS (SELECT source, object_id, max(us) AS seen_us, (object_id % 4 + 1) * 300000000 AS cadence, object_id % 9 = 0 AS daily FROM ev WHERE obs_us <= {AS_OF} GROUP BY source, object_id)
SELECT source, object_id, seen_us, CASE WHEN daily THEN {AS_OF} - seen_us > {4 * DAY} ELSE {AS_OF} - seen_us > greatest(cadence * 5 // 2, 900000000) END AS stale, object_id % 2 = 0 AS eligible FROM s""")
def eligibility_staleness(spark: SparkSession, d: str) -> DataFrame:
    """An observation is stale after 2.5 cadences, fifteen minutes at least; daily ones after four days.

    All objects with their eligible flag, which the tables stand in for by an even id.
    """
    s = B.as_of(events(spark, d), AS_OF).groupBy("source", "object_id").agg(F.max("us").alias("seen_us"))
    age, cadence = F.lit(AS_OF) - F.col("seen_us"), (F.col("object_id") % 4 + 1) * 300_000_000
    stale = F.when(F.col("object_id") % 9 == 0, age > 4 * DAY).otherwise(age > F.greatest(F.floor(cadence * 5 / 2), F.lit(15 * MINUTE)))
    return s.select("source", "object_id", "seen_us", (F.col("object_id") % 2 == 0).alias("eligible"), stale.alias("stale"))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') GROUP BY 1")
def semi_join_scope(spark: SparkSession, d: str) -> DataFrame:
    """Objects linked to an active scope."""
    asia = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(asia, "c_nationkey", "left_semi").join(done, "c_custkey", "left_semi").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


_KINDS = ("click", "error", "purchase", "signup", "view")
_STATE = [("name", "$.name", "string", "VARCHAR"), *[(k, f"$.stats.{k}", "double", "DOUBLE") for k in _KINDS], ("last", "$.deep.a.last", "bigint", "BIGINT"), ("flag", "$.flag", "boolean", "BOOLEAN")]
_PATCH_SQL = """'{"name":"' || source || '","stats":{"' || source || '":' || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE CAST(v AS VARCHAR) END || '},"deep":{"a":{"last":' || (user_id // 10) || '}},"flag":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE 'true' END || '}'"""


@query(f"""WITH {EV}, l AS (SELECT object_id, list({_PATCH_SQL} ORDER BY us, event_id) AS patches, list(event_id ORDER BY us, event_id) AS ids FROM ev GROUP BY 1),
i AS (SELECT object_id, i, ids[i] AS event_id, CAST(list_reduce(patches[1:i], lambda a, b: CAST(json_merge_patch(a, b) AS VARCHAR), '{{}}') AS JSON) AS doc FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM l)),
x AS (SELECT object_id, i, event_id, {", ".join(f"CAST(json_extract_string(doc, '{path}') AS {kind}) AS {n}" for n, path, _, kind in _STATE)} FROM i),
c AS (SELECT *, i = 1 OR (SELECT true) AND ({" OR ".join(f"{n} IS DISTINCT FROM lag({n}) OVER w" for n, *_ in _STATE)}) AS changed FROM x WINDOW w AS (PARTITION BY object_id ORDER BY i))
SELECT object_id, event_id, CAST(sum(1) OVER (PARTITION BY object_id ORDER BY i) AS BIGINT) AS version, {", ".join(n for n, *_ in _STATE)} FROM c WHERE changed""")
def merge_patches(spark: SparkSession, d: str) -> DataFrame:
    """K2 R2: versions of each object's document by patches in order of time; those that change nothing make none."""
    number = F.when(F.col("event_id") % 7 == 0, "null").otherwise(F.col("v").cast("string"))
    flag = F.when(F.col("event_id") % 3 == 0, "null").otherwise("true")
    parts = ['{"name":"', "source", '","stats":{"', "source", '":', number, '},"deep":{"a":{"last":', F.expr("cast(user_id div 10 as string)"), '}},"flag":', flag, "}"]
    patch = F.concat(*[F.lit(p) if isinstance(p, str) and p != "source" else p for p in parts])
    made = P.versions(events(spark, d).withColumn("patch", patch), "object_id", ["us", "event_id"], "patch")
    return made.select("object_id", "event_id", "version", *[F.expr(f"try_variant_get(document, '{path}', '{kind}')").alias(n) for n, path, kind, _ in _STATE])
