"""Resumable ingestion with Structured Streaming: each file once, state kept in checkpoints and tables."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str | None = None) -> None:
    """Everything that is there and not yet ingested, to Parquet; with ``key``, rows whose key came before are dropped."""
    rows = stream.dropDuplicates([key]) if key else stream
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keep_lowest(stream: DataFrame, table: str, checkpoint: str, by: list[str], rank: str, k: int, enough: Callable[[DataFrame], bool] | None = None) -> None:
    """Per group the ``k`` rows of least rank over all batches, in versions of a table; the query is stopped once ``enough`` says so.

    What has not been read by then stays unread: a batch that starts after the stop fails before it is committed, and the next run on
    this checkpoint reads it. A batch that is replayed writes its own version again, so the result is the same.
    """
    done = threading.Event()

    def merge(batch: DataFrame, n: int) -> None:
        if done.is_set():
            raise InterruptedError("enough rows are there: this batch stays unread")
        spark = batch.sparkSession
        rows = batch if n == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{table}/v{n - 1}"))
        kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(rank))).where(F.col("_n") <= k).drop("_n")
        kept.write.mode("overwrite").parquet(f"{table}/v{n}")
        if enough is not None and enough(spark.read.schema(batch.schema).parquet(f"{table}/v{n}")):
            done.set()

    running = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while True:
        try:
            if running.awaitTermination(1):
                return
        except StreamingQueryException:
            if not done.is_set():
                raise
            return
        if done.is_set():
            running.stop()
            return


def last_version(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The newest of the versions that ``keep_lowest`` wrote."""
    versions = spark.read.schema(schema).parquet(f"{table}/v*").withColumn("_v", F.regexp_extract(F.input_file_name(), r"/v(\d+)/", 1).cast("int"))
    return versions.join(F.broadcast(versions.agg(F.max("_v").alias("_v"))), "_v").drop("_v")


def stale(stored: str | None, current: str) -> bool:
    """Whether a stored fingerprint no longer fits, so that its checkpoint must go."""
    return stored is None or stored != current


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def invalidate(spark: SparkSession, folder: str, current: str, staged: tuple[str, ...] = ("out",)) -> bool:
    """Whether an ingestion under ``folder`` starts anew: its stored fingerprint differs from ``current``, or staged rows have vanished.

    Then the checkpoint (``check``) and the staged tables go and the fingerprint is stored. A folder without
    any of them is new and only gets its fingerprint.
    """
    mark, files_ = _path(spark, f"{folder}/fingerprint")
    stored = spark.read.text(mark.toString()).first() if files_.exists(mark) else None
    there = lambda name: files_.exists(_path(spark, f"{folder}/{name}")[0])
    gone = there("check") and not all(there(n) for n in staged)
    if not stale(stored[0] if stored else None, current) and not gone:
        return False
    for name in ("check", *staged):
        files_.delete(_path(spark, f"{folder}/{name}")[0], True)
    spark.createDataFrame([(current,)], "value string").coalesce(1).write.mode("overwrite").text(mark.toString())
    return True
