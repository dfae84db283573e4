"""Numbers and times as the feedback workload reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column) -> Column:
    """Number of a string; booleans are 1 and 0, blank and unreadable ones null."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))


def parse_ts(c: Column) -> Column:
    """Timestamp of epoch seconds or an ISO string; falsy and unreadable values are null."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    return F.when((text == "") | (number == 0), None).when(number.isNotNull(), F.timestamp_micros((number * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(text))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1_000_000


def freshness_days(epoch: Column, now: float) -> Column:
    """Days since ``epoch`` seconds, not below 0; null for a missing or zero time."""
    return F.when(epoch != 0, F.greatest(F.lit(0.0), (F.lit(float(now)) - epoch) / 86_400))

