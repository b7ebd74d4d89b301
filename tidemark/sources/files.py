"""Files in and out: CSV, JSON, JSON lines, XML, watched folders; rows normalised and checked on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("object_id", T.StringType()),
        T.StructField("objects", T.StringType()),
        T.StructField("occurred_at", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("extra", T.StringType()),
    ]
)
KINDS = ("snapshot", "participation", "content", "coverage", "quote", "forecast", "claim")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. A local one only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines give no row."""
    return spark.read.json(path, schema=schema)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole files that hold {"records": [...]}."""
    whole = spark.read.json(path, schema=T.StructType([T.StructField("records", T.ArrayType(schema))]), multiLine=True)
    return whole.select(F.explode("records").alias("r")).select("r.*")


def read_xml(spark: SparkSession, path: str, row: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def normalised(rows: DataFrame, default_source: str) -> DataFrame:
    """Blank strings to null, JSON text to maps, a lone object_id to a map, defaults filled, a content id where none is given."""
    r = rows.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    objects = F.coalesce(F.from_json("objects", "map<string,string>"), F.when(F.col("object_id").isNotNull(), F.create_map("object_id", F.lit("explicit"))))
    own = F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in ("kind", "source", "object_id", "occurred_at", "entity_id", "metric", "value")]), 256), 1, 32)
    return r.withColumn("objects", objects).withColumn("source", F.coalesce("source", F.lit(default_source))).withColumn("extra", F.from_json("extra", "map<string,string>")).withColumn("record_id", F.coalesce("record_id", own))


def instant(text: Column) -> Column:
    """A timestamp from text that names its offset; anything else is null."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): known kind, time with an offset, finite value, a real actor for a participation. The bad carry all their reasons."""
    value = F.col("value").try_cast("double")
    reasons = F.filter(
        F.array(
            F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind"),
            F.when(instant(F.col("occurred_at")).isNull(), "time"),
            F.when(F.col("value").isNotNull() & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))), "value"),
            F.when((F.col("kind") == "participation") & (F.col("entity_id").isNull() | F.col("entity_id").isin("[deleted]", "[removed]")), "actor"),
        ),
        lambda x: x.isNotNull(),
    )
    marked = rows.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def append_new(batch: DataFrame, path: str, key: str, schema: str) -> None:
    """Appends rows whose key the table lacks, the first of equal keys; safe to repeat."""
    from tidemark.operators.bitemporal import first_wins

    spark = batch.sparkSession
    stored = spark.read.schema(schema).parquet(path) if _exists(spark, path) else None
    first_wins(batch, stored, key, *[c for c in batch.columns if c != key][:1]).write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


LEDGER = "name string, digest string, poll long"


def fresh_files(spark: SparkSession, folder: str, ledger: str) -> DataFrame:
    """(name, digest, content): files of the folder whose name and content the ledger doesn't have together.

    Contents are hashed where they are read, so a file rewritten under its name is new, whatever its time and length, and one that was only touched
    is not. A file is one row, so it must fit in a task.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = found.select(F.col("path").alias("name"), F.sha2("content", 256).alias("digest"), "content")
    return found.join(spark.read.schema(LEDGER).parquet(ledger), ["name", "digest"], "left_anti") if _exists(spark, ledger) else found


def poll(spark: SparkSession, folder: str, table: str, ledger: str, number: int, schema: str, key: str) -> None:
    """Appends the JSON lines of fresh files where their key is new, then notes the files. A poll that dies between the two is safe to repeat:
    its rows' keys are no longer new. Lines that are no JSON give no row;
    rows of one key in one poll count once."""
    from tidemark.operators.bitemporal import first_wins

    files = fresh_files(spark, folder, ledger)
    # Read once, and kept while both tables are written.
    kept = scratch(spark, "fresh")
    files.write.parquet(kept)
    fresh = spark.read.schema(files.schema).parquet(kept)
    lines = fresh.select("name", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("place", "line")).where("trim(line) <> ''")
    rows = lines.select(F.struct("name", "place").alias("at"), F.from_json("line", schema).alias("r")).where(F.col(f"r.{key}").isNotNull())
    rows = rows.groupBy(f"r.{key}").agg(F.min_by("r", "at").alias("r")).select("r.*", F.lit(number).cast("long").alias("poll"))
    stored = spark.read.schema(rows.schema).parquet(table) if _exists(spark, table) else None
    first_wins(rows, stored, key, *[c for c in rows.columns if c != key][:1]).write.mode("append").parquet(table)
    fresh.select("name", "digest", F.lit(number).cast("long").alias("poll")).write.mode("append").parquet(ledger)


def put_file(lines: DataFrame, path: str) -> None:
    """Text rows, sorted, as one file of that name, which replaces one that is there. For what has to be one file: all rows go through one task."""
    spark = lines.sparkSession
    part = f"{path}.parts"
    lines.coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(part)
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    made = next(f.getPath() for f in store.listStatus(hadoop.Path(part)) if f.getPath().getName().startswith("part-"))
    store.delete(hadoop.Path(path), False)
    store.rename(made, hadoop.Path(path))
    store.delete(hadoop.Path(part), True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder; plans that go on begin there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
