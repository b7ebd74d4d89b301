"""Structured Streaming over the event log: windows, sessions, dedupe, state, ingestion."""

from __future__ import annotations

import threading
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.files import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PROGRESS = "run string, batch long, rows long, seconds double"


def event_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Events as they come, with a watermark on their time. The watermark only bounds state; stored rows are never dropped by it."""
    raw = spark.readStream.schema(EVENTS).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there into a Parquet sink, and reads the sink: rows of closed windows, each once."""
    spark = stream.sparkSession
    out, log = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-log")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(stream: DataFrame, width: str) -> DataFrame:
    w = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("user_id")).cast("long").alias("actors"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "actors")


def sliding(stream: DataFrame, width: str, step: str) -> DataFrame:
    w = stream.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    w = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def deduplicated(stream: DataFrame, key: str) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark([key])


def first_seen(stream: DataFrame) -> DataFrame:
    """(user_id, first_us, n): running state of each actor, put out whenever it changes."""

    def update(key: tuple, frames, state: GroupState):
        first, n = state.get if state.exists else (None, 0)
        for pdf in frames:
            low = int(pdf["us"].min())
            first = low if first is None else min(first, low)
            n += len(pdf)
        state.update((first, n))
        yield pd.DataFrame({"user_id": [key[0]], "first_us": [first], "n": [n]})

    rows = stream.select("user_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, first_us long, n long", "first_us long, n long", "append", GroupStateTimeout.NoTimeout)


def ingest(spark: SparkSession, folder: str, schema, table: str, key: str) -> int:
    """Files of a watched folder, each read once by the checkpoint, appended where their key is new. Returns the rows stored."""
    from tidemark.sources.files import append_new, checked, normalised

    log = scratch(spark, "ingest-log")

    def store(batch: DataFrame, _: int) -> None:
        good, _bad = checked(normalised(batch, "local"))
        rows = good.select("record_id", "kind", "source", "occurred_at", "value")
        append_new(rows, table, key, rows.schema)

    query = spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(store).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(table).count()


def fanned_out(stream: DataFrame, raw: str, analyse: Callable[[DataFrame], DataFrame], results: str, log: str, every: str | None = None, name: str | None = None):
    """Each batch is appended to `raw` and, once that is done, analysed; both tables carry the batch's number, so a batch that is
    run again replaces its own rows. `every`: a processing interval such as '300 seconds'; None takes what is there and ends."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{raw}/batch={number}")
        # What was appended is read back: the source is read once.
        stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{raw}/batch={number}")
        analyse(stored).write.mode("overwrite").parquet(f"{results}/batch={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", log)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Progress(StreamingQueryListener):
    """Writes what each batch of one query reports to a table, so that nothing is forgotten however long it runs. Rows are held for at most
    `held` batches, and written when the query ends; `done` is set then."""

    def __init__(self, spark: SparkSession, table: str, name: str, held: int = 20) -> None:
        self.spark, self.table, self.name, self.most = spark, table, name, held
        self.rows: list[tuple] = []
        self.ids: set[str] = set()
        self.done = threading.Event()

    def _write(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.table)
            self.rows = []

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.ids.add(str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name and p.numInputRows:
            self.rows.append((str(p.runId), int(p.batchId), int(p.numInputRows), float(p.durationMs.get("triggerExecution", 0)) / 1000))
            if len(self.rows) >= self.most:
                self._write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self.ids:
            self._write()
            self.done.set()


def progress(spark: SparkSession, table: str) -> DataFrame:
    """(batch, rows, seconds) of all batches that a `Progress` wrote; of a batch that was run again the last report."""
    rows = spark.read.schema(PROGRESS).parquet(table)
    return rows.groupBy("batch").agg(F.max_by("rows", "seconds").alias("rows"), F.max("seconds").alias("seconds"))
