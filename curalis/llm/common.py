"""Helpers that the training-data operators share: staging, tokenizer files, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SEED = 20240607


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session sets none (tests on one machine), a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session ended before: its folder goes with it
        pass


#: Paths of the tables staged since each open ``working`` block began.
_WORKING: list[list[str]] = []


@contextlib.contextmanager
def working(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside the block are removed at its end, but for those given to the function that the block gets.

    What the block hands on must read kept tables only.
    """
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._staged_at)
        return df

    _WORKING.append(made)
    try:
        yield keep
    finally:
        _WORKING.pop()
        for path in made:
            if path not in kept:
                _remove(spark, path)
        if _WORKING:
            _WORKING[-1].extend(kept)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later steps restart from the table, not from its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    if _WORKING:
        _WORKING[-1].append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._staged_at = path
    return made


def slots(spark: SparkSession, least: int = 1) -> int:
    """How many partitions to deal heavy Python work into: the session's shuffle setting, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that occurs in ``edges`` (long columns ``a``, ``b``).

    Alternates large-star and small-star steps on the edge table; each round is staged, so
    lost executors cost one round. Returns ``node``, ``component``. Hot nodes need no grouped
    list of neighbours: both steps are a min-aggregate and an equi-join. An empty table gives
    an empty result.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = stage(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def both(x: DataFrame) -> DataFrame:
        return x.select("a", "b").unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def settled(x: DataFrame) -> bool:
        """Whether each node leads to one node only, and that one nowhere: then these are the components."""
        twice = x.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        chained = x.join(x.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        return not twice.select("a").unionByName(chained.select("a")).limit(1).count()

    for _ in range(max_rounds):
        if settled(e):
            break
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        near = both(e)
        low = stage(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "low")
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "large")
        # small star: smaller neighbours and the node itself are linked to the smallest of them
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
        e = stage(small.where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
