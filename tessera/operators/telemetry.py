"""Telemetry events ``(ts, metric, label, value)``: counters, drift, search health."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counter_rollup(events: DataFrame, labels: list[str], value: str | None = None) -> DataFrame:
    """Totals of each combination of labels, and of each level above it."""
    total = F.count("*") if value is None else F.sum(value)
    return events.rollup(*labels).agg(total.alias("total"))


def score_drift(results: DataFrame, band: float = 0.2) -> DataFrame:
    """One row: mean and spread of adjusted minus base score, and whether the mean leaves the band."""
    delta = F.col("adjusted_score") - F.col("base_score")
    return results.agg(F.count("*").alias("n"), F.avg(delta).alias("mean_delta"), F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"), (F.abs(F.avg(delta)) > band).alias("outside_band"))


def drift_histogram(results: DataFrame, low: float = -1.0, high: float = 1.0, buckets: int = 20) -> DataFrame:
    delta = F.col("adjusted_score") - F.col("base_score")
    return results.groupBy(F.width_bucket(delta, F.lit(low), F.lit(high), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))


def health_aggregates(hit, miss, failed, latency) -> list:
    """Hit ratio (denominator at least 1), failure ratio, P95 latency."""
    hits, misses = F.count_if(hit), F.count_if(miss)
    return [(hits / F.greatest(hits + misses, F.lit(1))).alias("hit_ratio"), (F.count_if(failed) / F.greatest(F.count("*"), F.lit(1))).alias("failure_ratio"), F.percentile_approx(latency, 0.95, 10_000).alias("p95_latency")]


def with_quantile(counts: DataFrame, by: str, value: str, n: str = "n", share: str = "0.95") -> DataFrame:
    """``counts``, a row for each ``by`` and value with its number ``n``, and ``reached``: the value where it is at or above the quantile, else null.

    The least ``reached`` of a group is the exact quantile, for any number of rows: values are summed up in sorted
    order, which Spark may spill. Null values don't count.
    """
    known = F.when(F.col(value).isNotNull(), F.col(n))
    w = Window.partitionBy(by)
    upto = F.sum(known).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A decimal share, so that 0.95 of 20 rows are 19.
    place = F.ceil(F.lit(Decimal(share)) * F.sum(known).over(w))
    return counts.withColumn("reached", F.when(upto >= place, F.col(value)))


def search_health(events: DataFrame, window: str, hit, miss, failed, latency) -> DataFrame:
    """Search health of each window of ``ts``, with the exact P95."""
    counts = events.groupBy(F.window("ts", window).alias("w"), latency.alias("latency")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"), F.count_if(failed).alias("failures"))
    counts = with_quantile(counts, "w", "latency")
    n, hits, misses, failures = (F.sum(c) for c in ("n", "hits", "misses", "failures"))
    out = counts.groupBy("w").agg(n.alias("n"), (hits / F.greatest(hits + misses, F.lit(1))).alias("hit_ratio"), (failures / F.greatest(n, F.lit(1))).alias("failure_ratio"), F.min("reached").alias("p95_latency"))
    return out.select(F.col("w.start").alias("window_start"), "n", "hit_ratio", "failure_ratio", "p95_latency")


def alert_episodes(windows: DataFrame, rules: dict[str, tuple], slide_seconds: int) -> DataFrame:
    """Alerts that held: one row per episode: rule, first_window, last_window, fired_at, n_windows, worst.

    ``windows`` has window_start and the values of the rules; a rule is ``(breach condition, value, worst, seconds)``,
    where ``worst`` is ``max`` or ``min``. A rule fires when every window for ``seconds`` breaches, one each
    ``slide_seconds``; a window that is missing, null or well ends an episode. Each rule has a row per window,
    as many as time has windows.
    """
    out = None
    for name, (breach, value, worst, seconds) in rules.items():
        least = max(1, -(-seconds // slide_seconds))
        bad = windows.where(breach).select("window_start", value.alias("value"), F.unix_seconds(F.col("window_start").cast("timestamp")).alias("s"))
        # Windows in a row keep the same distance to their number.
        number = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy("s"))
        runs = bad.withColumn("run", F.col("s") - slide_seconds * number)
        got = runs.groupBy("run").agg(F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"), F.count("*").alias("n_windows"), (F.max if worst == "max" else F.min)("value").alias("worst"))
        got = got.where(F.col("n_windows") >= least).select(
            F.lit(name).alias("rule"), "first_window", "last_window", (F.col("first_window") + F.make_dt_interval(secs=F.lit(slide_seconds * (least - 1)))).alias("fired_at"), "n_windows", "worst"
        )
        out = got if out is None else out.unionByName(got)
    return out
