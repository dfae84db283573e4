"""Stored tables: chunks, graph, ledgers, runs, reports, models."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_LOCAL_DIRS: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """Name of a new folder that driver and executors share, below the one that ``spark.checkpoint.dir`` names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        base = _LOCAL_DIRS[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as read from a new Parquet table in the shared folder: computed once, and columns can still be pruned.

    The table outlives the executors. Nothing here deletes it, since later plans read it lazily; who
    owns the folder empties it when no result is in use.
    """
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_chunks(current: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """``new`` replaces rows of ``current`` with its key."""
    return current.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_paths(current: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` replaces all rows of ``current`` of its paths, so no chunk of an older text stays."""
    return current.join(new.select("path").distinct(), "path", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_paths(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, nodes and edges without those of the removed paths."""
    gone = removed.select("path").distinct()
    dead = nodes.join(gone, "path", "left_semi").select("id").unionByName(chunks.join(gone, "path", "left_semi").select(F.concat(F.lit("Chunk:"), "chunk_id").alias("id"))).distinct()
    edges = edges.join(dead.select(F.col("id").alias("src")), "src", "left_anti").join(dead.select(F.col("id").alias("dst")), "dst", "left_anti")
    return chunks.join(gone, "path", "left_anti"), nodes.join(dead, "id", "left_anti"), edges


def write_snapshot(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a new snapshot folder; an existing one is an error."""
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def retain_latest(df: DataFrame, ts: str, n: int, by: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """The newest ``n`` snapshots, of each ``by`` if given."""
    order = [F.desc(ts), *([F.desc(tie)] if tie else [])]
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


@dataclass
class RankingModel:
    model_type: str = "linear_regression"
    created_at: str = ""
    feature_names: list[str] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0
    metrics: dict[str, float] = field(default_factory=dict)
    training_rows: int = 0


MODEL_SCHEMA = "model_type string, created_at string, feature_names array<string>, coefficients array<double>, intercept double, metrics map<string,double>, training_rows long"


def save_model(spark: SparkSession, model: RankingModel, path: str) -> None:
    spark.createDataFrame([asdict(model)], MODEL_SCHEMA).coalesce(1).write.json(path)


def load_model(spark: SparkSession, path: str) -> RankingModel:
    """A saved model; absent fields have their defaults."""
    row = spark.read.schema(MODEL_SCHEMA).json(path).first()
    return RankingModel(**{k: v for k, v in row.asDict().items() if v is not None})
