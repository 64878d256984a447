"""Lateness, deduplication and sessions of event streams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from smeltry.functions.ladders import MONITOR_DELAY, Ladder
from smeltry.operators import rows as R

LATE_BOUND = "48 hours"
SALES_ALERT_HOURS = 6.0
ACTIVITY_ALERT_HOURS = 1.0
LAG_LIMIT = 10_000


def watermark(df: DataFrame, ts: str, bound: str = LATE_BOUND) -> DataFrame:
    """Event-time watermark; a zone-less time is read in the session zone first."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, bound)


def dedupe_stream(df: DataFrame, keys: list[str], ts: str, bound: str = LATE_BOUND) -> DataFrame:
    """Drop repeats of a key that arrive within the late bound; state is dropped after it."""
    return watermark(df, ts, bound).dropDuplicatesWithinWatermark(keys)


def delay_histogram(
    df: DataFrame, event_ts: str, ingest_ts: str, ladder: Ladder = MONITOR_DELAY,
    every: str = "30 seconds", bound: str = LATE_BOUND, by: str = "topic",
) -> DataFrame:
    """Message counts per arrival window, topic and delay label.

    Windows are over arrival time, which moves forward, so late events do not
    hold windows open. Rows are counted map-side before the shuffle.
    """
    delayed = R.with_delay(df, event_ts, ingest_ts, ladder)
    if delayed.isStreaming:
        delayed = watermark(delayed, ingest_ts, bound)
    return (
        delayed.groupBy(F.window(ingest_ts, every).alias("_w"), by, "delay_category")
        .agg(F.count(F.lit(1)).alias("messages"))
        .select(
            F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), by,
            "delay_category", "messages",
        )
    )


def delay_totals(histogram: DataFrame, by: str = "topic") -> DataFrame:
    """Counts and percentages per topic and label over all windows."""
    sums = histogram.groupBy(by, "delay_category").agg(F.sum("messages").alias("messages"))
    whole = F.sum("messages").over(W.partitionBy(by))
    return sums.withColumn("percent", F.round(F.col("messages") * 100.0 / whole, 4))


def high_delay_alerts(df: DataFrame, threshold_hours: float = SALES_ALERT_HOURS) -> DataFrame:
    """Rows whose ``delay_hours`` exceed the threshold; stateless."""
    return df.filter(F.col("delay_hours") > threshold_hours)


def recent_high_delays(
    df: DataFrame, order: list[Column], threshold_hours: float = SALES_ALERT_HOURS, last: int = 50, show: int = 5,
) -> DataFrame:
    """Of the ``last`` newest rows, the ``show`` newest above the threshold."""
    newest = df.orderBy(*order).limit(last)
    return high_delay_alerts(newest, threshold_hours).orderBy(*order).limit(show)


def _seconds(gap: str) -> int:
    n, unit = re.fullmatch(r"(\d+) (second|minute|hour)s?", gap).groups()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600}[unit]


def session_activity(df: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key: a silence longer than ``gap`` starts a new one.

    Events are first combined map-side into (key, gap-wide slot): two events of
    a slot are always less than a gap apart, so a slot never splits. Sessions
    are then chained over slots, of which a key has at most one per gap of
    elapsed time, however many events it has.
    """
    width = _seconds(gap)
    slots = df.groupBy(
        key, F.floor(F.unix_seconds(F.col(ts)) / width).alias("_slot")
    ).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    w = W.partitionBy(key).orderBy("_slot")
    apart = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(w))
    starts = slots.withColumn("_new", F.coalesce((apart > width * 1_000_000).cast("int"), F.lit(1)))
    numbered = starts.withColumn("session_no", F.sum("_new").over(w))
    return numbered.groupBy(key, "session_no").agg(
        F.min("_first").alias("session_start"), F.max("_last").alias("last_event"),
        F.sum("_n").alias("events"),
    )


def session_activity_stream(
    df: DataFrame, key: str, ts: str, gap: str = "30 minutes", bound: str = LATE_BOUND,
) -> DataFrame:
    """The same sessions on a stream, emitted once the watermark has passed them."""
    return (
        watermark(df, ts, bound).groupBy(F.session_window(ts, gap).alias("_s"), key)
        .agg(F.min(ts).alias("session_start"), F.max(ts).alias("last_event"), F.count(F.lit(1)).alias("events"))
        .select(key, "session_start", "last_event", "events")
    )


def activity_by_session(df: DataFrame, session: str = "session_id", ts: str = "event_time") -> DataFrame:
    """Span and size of sessions that carry their own id."""
    return df.groupBy(session).agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("last_event"), F.count(F.lit(1)).alias("events")
    )




def consumer_lag(envelope: DataFrame, committed: DataFrame, limit: int = LAG_LIMIT) -> DataFrame:
    """Lag of committed positions behind the end of each topic.

    ``committed`` has (topic, partition, position). A partition that was never
    committed counts from offset 0, a topic without any position is reported as
    not running.
    """
    ends = envelope.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
    per_topic = (
        ends.join(committed, ["topic", "partition"], "left")
        .withColumn("lag", F.col("end_offset") - F.coalesce("position", F.lit(0)))
        .groupBy("topic")
        .agg(
            F.sum("lag").alias("total_lag"), F.count(F.lit(1)).alias("partitions"),
            F.count("position").alias("_known"),
        )
    )
    status = (
        F.when(F.col("_known") == 0, F.lit("not_running"))
        .when(F.col("total_lag") > limit, F.lit("lagging")).otherwise(F.lit("running"))
    )
    return per_topic.withColumns(
        {
            "avg_lag": F.round(F.col("total_lag").cast("double") / F.col("partitions"), 4),
            "status": status,
        }
    ).drop("_known")


def consumer_health(lag: DataFrame) -> DataFrame:
    """One row: unhealthy if a topic is not running, degraded if one lags, else healthy."""
    level = (
        F.when(F.col("status") == "not_running", 2).when(F.col("status") == "lagging", 1).otherwise(0)
    )
    top = F.max(level)
    return lag.agg(
        F.when(top == 2, "unhealthy").when(top == 1, "degraded").otherwise("healthy").alias("overall_status"),
        F.count(F.lit(1)).alias("topics"),
    )
