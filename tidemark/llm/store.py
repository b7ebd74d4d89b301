"""Tables that a job writes for itself in the folder the executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it is unset and all runs on one machine (tests), a new local folder; elsewhere
    executors would not share one, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def free(names: list[str], wanted: str) -> str:
    """A column name that none of the names clashes with, in either case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def lean(spark: SparkSession) -> SparkSession:
    """Whole texts travel to Python in batches of 2000 rows where the session has Spark's own default of 10 000, so that a batch stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")
    return spark


_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and lost executors cost nothing done.

    instead_of: a written table that nothing reads any more once this one is there; it is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    if instead_of is not None:
        delete(instead_of)
    return out


def delete(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        path = _folders.pop(table, None) if table is not None else None
        if path:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def with_row_id(docs: DataFrame, id_column: str = "doc_id", name: str = "rid") -> DataFrame:
    """Adds `name`, a long unique to each row that sorts as the id does.

    Where ids are unique and never null, that is the id. Otherwise rows are
    ordered by (id, nulls first, then text) and numbered in a written table, so
    that a repeated row is a document of its own.
    """
    seen = docs.select(F.col(id_column).cast("long").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    worst = seen.agg(F.max("n").alias("n"), F.max(F.col("i").isNull().cast("int")).alias("nulls")).first()
    if (worst["n"] or 0) <= 1 and not worst["nulls"]:
        return docs.withColumn(name, F.col(id_column).cast("long"))
    ordered = docs.repartitionByRange(F.col(id_column).asc_nulls_first(), F.col("text")).sortWithinPartitions(F.col(id_column).asc_nulls_first(), "text")
    return written(ordered.withColumn(name, F.monotonically_increasing_id()), "rows")
