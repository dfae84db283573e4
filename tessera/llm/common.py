"""Shared helpers of the training-data operators: scratch tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's ``spark.checkpoint.dir`` names it.

    Only a local-mode session without that setting gets a temporary folder; on a cluster the
    setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL_DIRS[app]


class Scratch:
    """Parquet tables in the shared folder that cut lineage; every one survives a lost executor.

    Results are lazy and read these tables, so an operator deletes only those that nothing reads any
    more. Who owns the folder empties it when no result is in use.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back; ``drop`` removes the files."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_bucketed(self, df: DataFrame, name: str, by: str, n: int) -> DataFrame:
        """Like ``save``, in ``n`` buckets: a join by ``by`` needs no shuffle of it.

        ``n`` is at least the number of shuffle partitions, or Spark shuffles it all the same. Where ``df``
        is already dealt by ``by`` in as many partitions, a bucket is one file.
        """
        table = f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(n, by).format("parquet").option("path", self.path(name)).saveAsTable(table)
        out = self.spark.table(table)
        # The plan holds what it needs; the files stay, since they lie outside the warehouse.
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of saved frames that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is its smallest node.

    Alternating large-star and small-star contraction; each round is a written table, and the loop
    ends when every component is a star around its smallest node. A hub's rows are two integers each
    and stream through its join, so its degree needs no memory.
    """

    def stars(df: DataFrame) -> bool:
        """Whether no larger end has two smaller ones or is one itself; smaller ends are then the components."""
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(df.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()

    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = scratch.save(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        nxt = scratch.save(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        scratch.drop(large, now)
        now = nxt
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
