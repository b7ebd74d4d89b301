"""The fixture tables as the engine's entities. Times are microseconds since 1970 of the naive clock, whatever the session's zone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import on_workers

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participations: actor user_id, source event_type, object from props, value; known up to six minutes after they happen."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        micros("ts").alias("us"),
        (micros("ts") + (F.col("event_id") % 7) * MINUTE).alias("obs_us"),
        "user_id",
        F.col("event_type").alias("source"),
        F.get_json_object("props", "$.k").cast("long").alias("object_id"),
        F.col("value").cast("decimal(18,2)").alias("v"),
        F.floor(micros("ts") / DAY).alias("day"),
    )


#: The same for DuckDB.
EV = """ev AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) + (event_id % 7) * 60000000 AS obs_us, user_id, event_type AS source,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS object_id, CAST(value AS DECIMAL(18,2)) AS v, epoch_us(ts) // 86400000000 AS day FROM events)"""

#: 2024-01-20 12:00, the moment that point-in-time queries ask about.
AS_OF = 1_705_752_000_000_000


def registered() -> tuple[dict, dict[str, str], Callable]:
    """A module's queries, their SQL, and the decorator that adds to both; without SQL a query is checked by its own tests."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
