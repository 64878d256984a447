"""Late arrivals in batch: finding, repairing, reconciling."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smeltry.functions import columns as C
from smeltry.functions.ladders import BATCH_DELAY, bucket
from smeltry.operators import keys as K
from smeltry.operators import upsert as U
from smeltry.plans.silver import silver_sales
from smeltry.sources import sinks

BUSINESS_KEY = ["marketplace_name", "seller_id", "product_id", "transaction_time"]


def with_arrival_delay(df: DataFrame, ts: str = "transaction_time", ingest: str = "ingestion_time") -> DataFrame:
    """Delay in hours (whole seconds, 2 digits), both dates, label and lateness."""
    seconds = F.unix_timestamp(ingest) - F.unix_timestamp(ts)
    return df.withColumns(
        {
            "arrival_delay_hours": F.round(seconds / F.lit(3600.0), 2),
            "event_date": F.to_date(ts),
            "ingestion_date": F.to_date(ingest),
        }
    ).withColumns(
        {
            "arrival_category": bucket(F.col("arrival_delay_hours"), BATCH_DELAY),
            "is_late_arrival": F.col("event_date") != F.col("ingestion_date"),
        }
    )


def late_rows(
    df: DataFrame, day: date | str, lookback_hours: int = 48, ts: str = "transaction_time",
    ingest: str = "ingestion_time", partition: str | None = None,
) -> DataFrame:
    """Rows ingested on ``day`` whose event lies in the hours before it.

    ``partition`` is the day column by which ``ts`` is laid out in files.
    """
    start = datetime.combine(C.as_date(day), datetime.min.time())
    if partition is not None:
        first = (start - timedelta(hours=lookback_hours)).date()
        df = df.filter(F.col(partition).between(F.lit(first), C.day_lit(day)))
    window = df.filter(
        C.on_day(ingest, day)
        & (F.col(ts) >= F.lit(start - timedelta(hours=lookback_hours)).cast("timestamp"))
        & (F.col(ts) < F.lit(start).cast("timestamp"))
    )
    return with_arrival_delay(window, ts, ingest).filter("is_late_arrival")


def late_arrivals(
    df: DataFrame, day: date | str, lookback_hours: int = 48, ts: str = "transaction_time",
    ingest: str = "ingestion_time", ties: Sequence[str] = ("transaction_id", "product_id"),
) -> DataFrame:
    """``late_rows`` with the longest delay first.

    Many rows share a delay; ``ties`` lets the sort split them over tasks.
    """
    rows = late_rows(df, day, lookback_hours, ts, ingest)
    return rows.orderBy(
        F.desc("arrival_delay_hours"), ts, *[c for c in ties if c in rows.columns]
    )


def delay_stats(late: DataFrame) -> DataFrame:
    d = "arrival_delay_hours"
    return late.groupBy("arrival_category").agg(
        F.count(F.lit(1)).alias("count"), F.avg(d).alias("avg_delay_hours"),
        F.max(d).alias("max_delay_hours"), F.min(d).alias("min_delay_hours"),
    ).orderBy("avg_delay_hours")


def marketplace_stats(late: DataFrame) -> DataFrame:
    d = "arrival_delay_hours"
    return late.groupBy("marketplace_name").agg(
        F.count(F.lit(1)).alias("late_count"), F.avg(d).alias("avg_delay"), F.max(d).alias("max_delay"),
    ).orderBy(F.desc("late_count"), "marketplace_name")


def late_since_cutoff(df: DataFrame, cutoff: datetime | str, ts: str = "event_time", ingest: str = "ingestion_time") -> DataFrame:
    """Rows that happened before the cut-off but were ingested after it."""
    c = F.lit(cutoff).cast("timestamp")
    return df.filter((F.col(ingest) > c) & (F.col(ts) < c))


def late_report(sources: Sequence[tuple[str, DataFrame, str]], cutoff: datetime | str) -> DataFrame:
    """Late rows per source; ``sources`` are (name, frame, event time column)."""
    out = None
    for name, df, ts in sources:
        n = late_since_cutoff(df, cutoff, ts).agg(F.count(F.lit(1)).alias("late_rows"))
        row = n.select(F.lit(name).alias("source"), "late_rows")
        out = row if out is None else out.unionByName(row)
    return out


def keep_latest_by_business_key(late: DataFrame, keys: Sequence[str] = tuple(BUSINESS_KEY)) -> DataFrame:
    """Of rows sharing a business key, the last ingested; ties by transaction id and amount."""
    order = [
        F.col("ingestion_time").desc_nulls_last(), F.col("transaction_id").asc(),
        F.col("amount").asc_nulls_last(), F.col("quantity").asc_nulls_last(),
    ]
    return K.latest_per_key(late, list(keys), order)


def affected_dates(late: DataFrame) -> DataFrame:
    return late.select("event_date").distinct()


def rebuilt(
    bronze: DataFrame, days: DataFrame, customer: Column | None = None, channel: Column | None = None,
    processed: datetime | None = None, partition: str | None = None,
) -> DataFrame:
    """Silver rows of the days in column ``_day``.

    ``partition`` is a day column by which bronze is laid out: its own value meets the
    days, so that partitions are pruned while the query runs.
    """
    own = F.to_date("transaction_time") if partition is None else F.col(partition)
    rows = bronze.join(days, own == F.col("_day"), "left_semi")
    return silver_sales(rows, customer=customer, channel=channel, processed=processed)


def reprocess(
    bronze: DataFrame, silver: DataFrame, dates: DataFrame, customer: Column | None = None,
    channel: Column | None = None, processed: datetime | None = None, partition: str | None = None,
) -> DataFrame:
    """Silver with all affected days rebuilt from bronze in one pass.

    With ``partition``, the day column by which bronze is laid out, only touched days
    are read from it.
    """
    touched = dates.select(F.col("event_date").alias("_day")).distinct()
    fresh = rebuilt(bronze, touched, customer, channel, processed, partition)
    return U.replace_slice(
        silver, fresh, "transaction_date", touched.withColumnRenamed("_day", "transaction_date")
    )


def reprocessing_summary(late: DataFrame, day: date | str) -> DataFrame:
    d = "arrival_delay_hours"
    return late.agg(
        F.count(F.lit(1)).alias("total_late_arrivals"),
        F.count_distinct("marketplace_name").alias("affected_marketplaces"),
        F.count_distinct("event_date").alias("affected_dates"),
        F.avg(d).alias("avg_delay_hours"), F.max(d).alias("max_delay_hours"),
    ).withColumn("process_date", C.day_lit(day))


def key_presence(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Every key of either side with flags for where it occurs.

    Keys are brought together before they are reduced, as most occur once a side.
    """
    a = left.select(F.col(left_key).alias("key"), F.lit(True).alias("l"), F.lit(False).alias("r"))
    b = right.select(F.col(right_key).alias("key"), F.lit(False).alias("l"), F.lit(True).alias("r"))
    return (
        K.near(a.unionByName(b).filter("key IS NOT NULL"), ["key"]).groupBy("key")
        .agg(F.bool_or("l").alias("in_left"), F.bool_or("r").alias("in_right"))
    )


def reconcile(
    bronze: DataFrame, silver: DataFrame, start: datetime | str | None = None,
    end: datetime | str | None = None, ts: str = "transaction_time",
    bronze_key: str = "transaction_id", silver_key: str = "sale_id",
) -> DataFrame:
    """Distinct ids on both sides of a time range, ids missing from either, and whether they agree."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        keep = keep & (F.col(ts) < F.lit(end).cast("timestamp"))
    both = key_presence(bronze.filter(keep), bronze_key, silver.filter(keep), silver_key)
    return both.agg(
        F.count_if("in_left").alias("bronze_count"),
        F.count_if("in_right").alias("silver_count"),
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("missing_in_silver"),
        F.count_if(F.col("in_right") & ~F.col("in_left")).alias("missing_in_bronze"),
    ).withColumn("consistent", F.col("bronze_count") == F.col("silver_count"))


class LateRepair(NamedTuple):
    late: DataFrame
    resolved: DataFrame
    silver: DataFrame
    reconciliation: DataFrame


def late_repair(
    bronze: DataFrame, silver: DataFrame, day: date | str, lookback_hours: int = 48,
    customer: Column | None = None, channel: Column | None = None, processed: datetime | None = None,
) -> LateRepair:
    """The whole late-arrival run of a day: find, resolve, rebuild, compare."""
    late = late_rows(bronze, day, lookback_hours)
    resolved = keep_latest_by_business_key(late)
    repaired = reprocess(bronze, silver, affected_dates(resolved), customer, channel, processed)
    start = datetime.combine(C.as_date(day), datetime.min.time())
    return LateRepair(
        late, resolved, repaired,
        reconcile(bronze, repaired, start - timedelta(hours=lookback_hours), start),
    )


def repair_table(
    bronze: DataFrame, silver_table: str, day: date | str, lookback_hours: int = 48,
    customer: Column | None = None, channel: Column | None = None, processed: datetime | None = None,
    partition: str = "event_day", silver_partition: str = "transaction_date",
) -> list[date]:
    """The late-arrival run of a day on a stored silver table; returns the rebuilt days.

    Bronze is read for the days of the lookback only, by its partition, and only
    the partitions of days with late rows are written; a day that has no rows
    left is dropped. As many days come to the driver as the lookback spans.
    """
    late = late_rows(bronze, day, lookback_hours, partition=partition)
    days = sorted(r[0] for r in affected_dates(late).collect())
    if not days:
        return []
    spark = bronze.sparkSession
    fresh = silver_sales(bronze.filter(F.col(partition).isin(days)), customer=customer, channel=channel, processed=processed)
    touched = spark.createDataFrame([(d,) for d in days], f"{silver_partition} date")
    sinks.replace_slices_in_table(fresh, silver_table, silver_partition, touched)
    return days
