"""Linear ranking model: fit, predict, evaluate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import to_double
from ..sources.stores import RankingModel, cut_lineage

# Features of the ranking model, in order.
FEATURES = (
    "vector_score", "signal_subsystem_affinity", "signal_relationship_count", "signal_supporting_bonus",
    "signal_coverage_missing", "graph_context_present", "metadata_graph_context_included", "metadata_warnings_count",
)


def feature(name: str) -> Column:
    """A feature as a number; null and unreadable values are 0."""
    return F.coalesce(to_double(F.col(name)), F.lit(0.0))


def feature_rows(rows: DataFrame, names=FEATURES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric features and ``vote`` of the rows that have one."""
    return rows.select(*keep, *(feature(n).alias(n) for n in names), to_double(F.col("feedback_vote")).alias("vote")).where("vote is not null")


#: Triangular factors that one task, and at last the driver, merges at once.
FAN = 32


def _triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One triangular factor of a task's rows, as many rows as columns at most; blocks are taken in one by one."""
    r, n = None, 0
    for batch in batches:
        x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in batch.columns])
        if len(x):
            r, n = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r"), n + len(x)
    if r is not None:
        yield pa.RecordBatch.from_pydict({"n": [n], "r": [r.tobytes()]})


def triangular_factor(x: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows of numeric columns, and R of their QR factorisation.

    Tasks factor their rows, and factors are merged in a tree of tasks until ``FAN`` are left; R has the singular
    values of all rows, where their products would have the squares.
    """
    d = len(x.columns)
    rows = cut_lineage(x.select(*(F.col(c).cast("double") for c in x.columns)).mapInArrow(_triangle, "n long, r binary").withColumn("leaf", F.monotonically_increasing_id()))

    def merged(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([np.frombuffer(b).reshape(-1, d) for b in pdf["r"]]), mode="r")
        return pd.DataFrame({"n": [int(pdf["n"].sum())], "r": [r.tobytes()], "leaf": [int(key[0])]})

    while (leaves := rows.count()) > FAN:
        groups = -(-leaves // FAN)
        rows = cut_lineage(rows.withColumn("leaf", F.pmod(F.xxhash64("leaf"), F.lit(groups))).groupBy("leaf").applyInPandas(merged, "n long, r binary, leaf long"))
    left = rows.orderBy("leaf").collect()
    if not left:
        return 0, np.zeros((0, d))
    return sum(r["n"] for r in left), np.linalg.qr(np.vstack([np.frombuffer(r["r"]).reshape(-1, d) for r in left]), mode="r")


def train_model(rows: DataFrame, names=FEATURES, created_at: str = "") -> RankingModel:
    """Least squares with intercept, of minimum norm, from a triangular factor of the design and the votes."""
    d = len(names)
    # The intercept comes first, so what is left of the votes below it is their spread.
    x = feature_rows(rows, names).select(F.lit(1.0).alias("one"), *(F.col(n).alias(f"x{i}") for i, n in enumerate(names)), "vote")
    n, r = triangular_factor(x)
    if not n:
        raise ValueError("no rows with a vote")
    design, votes = r[:, : d + 1], r[:, d + 1]
    beta = np.linalg.lstsq(design, votes, rcond=np.finfo(float).eps * max(n, d + 1))[0]
    rss = float(np.sum((votes - design @ beta) ** 2))
    tss = float(np.sum(votes[1:] ** 2))
    scale = float(np.sum(votes**2)) * np.finfo(float).eps ** 2 * n
    r2 = 1 - rss / tss if tss > scale else float(rss <= scale)
    return RankingModel(created_at=created_at, feature_names=list(names), coefficients=[float(b) for b in beta[1:]], intercept=float(beta[0]), metrics={"mse": rss / n, "r2": float(r2)}, training_rows=int(n))


def predict(rows: DataFrame, model: RankingModel) -> DataFrame:
    """Rows with ``prediction``."""
    if not model.feature_names:
        raise ValueError("model without features")
    out = F.lit(float(model.intercept))
    for n, c in zip(model.feature_names, model.coefficients, strict=True):
        out = out + feature(n) * F.lit(float(c))
    return rows.withColumn("prediction", out)


def regression_metrics(pred: DataFrame, target: str = "vote") -> DataFrame:
    """One row: n, mse, r2; a constant target gives r2 1 if met exactly, else 0."""
    mean = pred.agg(F.avg(target).alias("m"))
    res = F.col(target) - F.col("prediction")
    sums = pred.crossJoin(mean).agg(F.count("*").alias("n"), F.avg(res * res).alias("mse"), F.sum((F.col(target) - F.col("m")) ** 2).alias("tss"), F.sum(res * res).alias("rss"))
    return sums.select("n", "mse", F.when(F.col("tss") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("rss") / F.col("tss")).alias("r2"))


def mean_ndcg(pred: DataFrame, k: int, target: str = "vote", request: str = "request_id", tie: tuple[str, ...] = ("rank", "chunk_id")) -> DataFrame:
    """One row: mean NDCG@k over requests whose ideal is not 0; 0 if there are none."""
    name = F.coalesce(F.col(request), F.lit("None"))
    w = Window.partitionBy("_r")
    ties = [F.col(t) for t in tie if t in pred.columns]
    rows = pred.withColumn("_r", name)
    gain = (F.pow(F.lit(2.0), F.col(target)) - 1) / F.log2(F.col("_at") + 1)

    def summed(order: list[Column], out: str) -> DataFrame:
        # Only the first k rows of a request leave a task, however many it has: the filter is applied before the shuffle.
        first = rows.withColumn("_at", F.row_number().over(w.orderBy(*order))).where(F.col("_at") <= k)
        return first.groupBy("_r").agg(F.sum(gain).alias(out))

    per = summed([F.desc("prediction"), *ties], "dcg").join(summed([F.desc(target)], "ideal"), "_r").where("ideal <> 0")
    return per.agg(F.coalesce(F.avg(F.col("dcg") / F.col("ideal")), F.lit(0.0)).alias(f"ndcg_at_{k}"), F.count("*").alias("n_requests"))


def ordinal_ranks(df: DataFrame, by: str, seq: str, out: str) -> DataFrame:
    """Global ranks from 0 without one task that holds all rows: range partitions and their bases."""
    parts = df.repartitionByRange(F.col(by), F.col(seq)).withColumn("_part", F.spark_partition_id())
    # Range bounds are sampled, so both readings below must see one and the same layout.
    parts = cut_lineage(parts)
    sizes, bases, base = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect()), [], 0
    for p, n in sizes:
        bases.append((p, base))
        base += n
    bases = df.sparkSession.createDataFrame(bases, "_part int, _base long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by, seq)) - 1
    return parts.withColumn("_in", inside).join(F.broadcast(bases), "_part").withColumn(out, F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")


def spearman(pred: DataFrame, target: str = "vote", seq: str = "seq") -> DataFrame:
    """One row: rank correlation over all rows, ties by ``seq``; null below two rows.

    Predictions that agree to nine places tie, so rounding noise of a fit can't order them.
    """
    ranked = ordinal_ranks(ordinal_ranks(pred.select(seq, target, F.round("prediction", 9).alias("prediction")), target, seq, "a"), "prediction", seq, "b")
    got = ranked.agg(F.count("*").cast("double").alias("n"), F.sum((F.col("a") - F.col("b")) ** 2).alias("d2"))
    return got.select(F.when(F.col("n") > 1, 1 - 6 * F.col("d2") / (F.col("n") * (F.col("n") ** 2 - 1))).alias("spearman"))
