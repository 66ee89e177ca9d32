"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` read back from the session's checkpoint folder; tests without one get a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def shared_folder(df_or_spark) -> str:
    """The folder of the session's ``spark.checkpoint.dir``; on one machine a temporary folder takes its place."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or "file://" + tempfile.mkdtemp(prefix="spark-stream-")).rstrip("/")


def scratch_folder(df_or_spark, name: str) -> str:
    """A new folder below ``shared_folder``, removed when the driver ends: for what a query stages in files of its own."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session ended before: its folder goes with it
            pass

    atexit.register(remove)
    return path


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of its column over the rows of the group up to and with this one.

    Rows are dealt by ranges of group and order, so a group of any size is spread over many tasks; sums
    inside a range are added to those of the group's ranges before it. ``order`` columns must tell the
    rows of a group apart.
    """
    named = df.withColumns({f"_v_{k}": c for k, c in sums.items()})
    dealt = checkpointed(named.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy("_range", *by).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = parts.select("_range", *by, *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({k: F.sum(f"_v_{k}").over(inside) for k in sums})
    names = {c: f"_b_{c}" for c in by}
    on = local["_range"] == F.col("_r")
    for c, n in names.items():
        on &= local[c].eqNullSafe(F.col(n))
    offsets = offsets.select(F.col("_range").alias("_r"), *[F.col(c).alias(n) for c, n in names.items()], *[f"_o_{k}" for k in sums])
    joined = local.join(offsets, on)
    return joined.select(*df.columns, *[(F.col(k) + F.col(f"_o_{k}")).alias(k) for k in sums])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row from 1 in the total order of ``order``, whose columns tell rows apart."""
    return running_sums(df, [], order, {name: F.lit(1)})
