"""Reports: coverage, lifecycle, run history, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import node_label
from .graph import orphan_nodes

DAY = 86_400
ISOLATED_LABELS = ("DesignDoc", "SourceFile", "TestCase", "IntegrationMessage")


def coverage_report(artifacts: DataFrame, removed: DataFrame, run_chunks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One summary row, and the artifacts without chunks. ``artifacts`` has path, artifact_type, chunk_count."""
    missing = artifacts.where(F.coalesce("chunk_count", F.lit(0)) == 0)
    total = F.lit(run_chunks) if run_chunks is not None else F.coalesce(F.sum("chunk_count"), F.lit(0))
    summary = artifacts.agg(F.count("*").alias("artifact_total"), total.cast("long").alias("chunk_count"), F.count_if(F.coalesce("chunk_count", F.lit(0)) == 0).alias("missing_count"))
    return summary.crossJoin(removed.agg(F.count("*").alias("removed_count"))), missing


def stale_docs(artifacts: DataFrame, days: int, now: float) -> DataFrame:
    """Documents whose last commit is older than ``days``."""
    cutoff = float(now) - max(0, days) * DAY
    return artifacts.where((node_label(F.col("artifact_type")) == "DesignDoc") & (F.col("git_timestamp") > 0) & (F.col("git_timestamp") < cutoff)).select("path", "subsystem", "git_timestamp")


def missing_tests(artifacts: DataFrame) -> DataFrame:
    """Subsystems with sources and without tests."""
    label = node_label(F.col("artifact_type"))
    counts = artifacts.groupBy(F.coalesce(F.nullif("subsystem", F.lit("")), F.lit("unknown")).alias("subsystem")).agg(F.count_if(label == "SourceFile").alias("source_files"), F.count_if(label == "TestCase").alias("test_cases"))
    return counts.where("source_files > 0 and test_cases = 0")


def isolated_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Isolated nodes of each label that has any."""
    return orphan_nodes(nodes, edges).where(F.col("label").isin(*ISOLATED_LABELS)).groupBy("label").agg(F.count("*").alias("n_isolated"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Isolated nodes by label, one row each."""
    return orphan_nodes(nodes, edges).where(F.col("label").isin(*ISOLATED_LABELS)).select("label", "id", "path", "name")


def lifecycle_summary(stale: DataFrame, isolated: DataFrame, untested: DataFrame, removed: DataFrame) -> DataFrame:
    """One row with the four counts."""
    kinds = {"stale_docs": stale, "isolated_nodes": isolated, "subsystems_missing_tests": untested, "removed_artifacts": removed}
    out = None
    for name, df in kinds.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)


def latest_run(runs: DataFrame, profile: str | None = None, lookback: int = 10) -> DataFrame:
    """The newest run of each profile among the newest ``lookback`` runs."""
    recent = recent_runs(runs, lookback)
    if profile is not None:
        recent = recent.where(F.col("profile") == profile)
    return recent.groupBy("profile").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"), F.max("created_at").alias("created_at"))


def lifecycle_history(snapshots: DataFrame, n: int, ts: str = "generated_at") -> DataFrame:
    """The newest ``n`` snapshots of each profile, numbered from the oldest."""
    w = Window.partitionBy("profile")
    kept = snapshots.withColumn("_back", F.row_number().over(w.orderBy(F.desc(ts)))).where(F.col("_back") <= n)
    return kept.withColumn("place", F.row_number().over(w.orderBy(ts))).drop("_back")


def run_deltas(snapshots: DataFrame, values: tuple[str, ...], ts: str = "generated_at") -> DataFrame:
    """Change of each value since the profile's snapshot before."""
    w = Window.partitionBy("profile").orderBy(ts)
    return snapshots.withColumns({f"{v}_delta": F.col(v) - F.lag(v).over(w) for v in values})


def health_status(snapshots: DataFrame, now: float, interval_minutes: int | None = None) -> DataFrame:
    """``(check_name, status, age_seconds)`` of ``(check_name, generated_at)``; a check without time is missing.

    ``overall`` is degraded where any check is not ok.
    """
    limit = 86_400 if interval_minutes is None else max(interval_minutes * 120, 3_600)
    last = snapshots.groupBy("check_name").agg(F.max("generated_at").alias("at"), F.count("*").alias("n"))
    age = F.when(F.col("at").isNotNull(), F.greatest(F.lit(0.0), F.lit(float(now)) - F.col("at")))
    rows = last.select("check_name", F.when(F.col("at").isNull(), "missing").when(age > limit, "stale").otherwise("ok").alias("status"), age.alias("age_seconds"))
    overall = rows.agg(F.when(F.bool_or(F.col("status") != "ok"), "degraded").otherwise("ok").alias("overall"))
    return rows.crossJoin(overall)
