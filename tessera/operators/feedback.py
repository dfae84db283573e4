"""Feedback events: flattening, votes, pruning, redaction, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import parse_ts, to_double
from ..sources.readers import FIELDS


def flatten_events(events: DataFrame) -> DataFrame:
    """Nested events as rows of the 22 training columns."""
    warnings, context = F.col("metadata.warnings"), F.col("context")
    n = F.coalesce(F.json_array_length(warnings), F.when(warnings.isNull(), 0).otherwise(1))
    given = {
        "signal_subsystem_affinity": F.col("signals.subsystem_affinity"),
        "signal_relationship_count": F.col("signals.relationship_count"),
        "signal_supporting_bonus": F.col("signals.supporting_bonus"),
        "signal_coverage_missing": F.col("signals.coverage_missing"),
        "context_json": context,
        "metadata_request_id": F.col("metadata.request_id"),
        "metadata_graph_context_included": F.col("metadata.graph_context_included"),
        "metadata_warnings_count": n,
    }
    return events.select(*(given.get(c, F.col(c)).alias(c) for c in FIELDS))


def require_vote(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("feedback_vote").isNotNull())


def parse_feedback(raw: DataFrame) -> DataFrame:
    """``(vote, note, comment)`` as feedback_vote and feedback_note."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return raw.withColumn("feedback_vote", to_double(F.col("vote"))).withColumn("feedback_note", F.coalesce(blank("note"), blank("comment"))).drop("vote", "note", "comment")


def export_dataset(events: DataFrame, with_vote: bool = False, limit: int | None = None, seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training rows and one row of statistics: total, written, skipped.

    ``limit`` counts after the vote filter, in order of ``seq``; none or 0 takes all.
    """
    keep = F.col("feedback_vote").isNotNull() if with_vote else F.lit(True)
    rows = events.where(keep)
    if limit:
        rows = rows.orderBy(seq).limit(limit) if seq else rows.limit(limit)
    written = F.least(F.count_if(keep), F.lit(limit)) if limit else F.count_if(keep)
    stats = events.agg(F.count("*").alias("total"), written.alias("written"), F.count_if(~keep).alias("skipped"))
    return flatten_events(rows), stats


def prune_feedback(events: DataFrame, now: str, max_age_days: int | None = None, max_requests: int | None = None, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Events of the newest requests, and one row: total, retained and removed requests.

    A request's time is its first event's; unreadable ones are of year 1. Requests of equal time keep
    their first-seen order. Where nothing would stay, everything does.
    """
    if max_age_days is None and max_requests is None:
        raise ValueError("give max_age_days or max_requests")
    named = events.where("request_id is not null and request_id <> 'None'")
    first = named.groupBy("request_id").agg(F.min_by("timestamp", seq).alias("ts"), F.min(seq).alias("first_seq"))
    first = first.withColumn("ts", F.coalesce(parse_ts(F.col("ts")), F.to_timestamp(F.lit("0001-01-01"))))
    kept = first
    if max_age_days is not None:
        kept = kept.where(F.col("ts") >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(max_age_days)))
    if max_requests is not None:
        kept = kept.orderBy(F.desc("ts"), "first_seq").limit(max_requests)
    counts = first.agg(F.count("*").alias("total_requests")).crossJoin(kept.agg(F.count("*").alias("n")))
    retained = F.when(F.col("n") == 0, F.col("total_requests")).otherwise(F.col("n"))
    stats = counts.select("total_requests", retained.alias("retained_requests"), (F.col("total_requests") - retained).alias("removed_requests"))
    some = kept.limit(1).count() > 0
    return (named.join(kept.select("request_id"), "request_id", "left_semi") if some else named), stats


def redact(rows: DataFrame, drop_query: bool = True, drop_context: bool = True, drop_note: bool = False, replacement: str | None = "") -> tuple[DataFrame, DataFrame]:
    """Populated sensitive fields replaced; one row with the rows in all and those that changed."""
    wanted = (["query"] if drop_query else []) + (["context_json", "context"] if drop_context else []) + (["feedback_note"] if drop_note else [])
    names = [c for c in wanted if c in rows.columns]
    filled = {c: F.col(c).isNotNull() & (F.col(c) != "") for c in names}
    changed = F.lit(False)
    for c in names:
        changed = changed | filled[c]
    stats = rows.agg(F.count("*").alias("total_rows"), F.count_if(F.coalesce(changed, F.lit(False))).alias("redacted_rows"))
    return rows.withColumns({c: F.when(filled[c], F.lit(replacement)).otherwise(F.col(c)) for c in names}), stats


def to_feedback_rows(results: DataFrame, votes: DataFrame, request: str = "request_id") -> DataFrame:
    """Results with rank 1..n and count within their request, and their votes."""
    w = Window.partitionBy(request)
    rows = results.withColumn("rank", F.row_number().over(w.orderBy(F.desc("adjusted_score"), "chunk_id"))).withColumn("result_count", F.count("*").over(w))
    return rows.join(votes, [request, "chunk_id"], "left")
