"""Dimensions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smeltry import schemas as S
from smeltry.functions import columns as C
from smeltry.operators import keys as K
from smeltry.operators import rows as R


def dim_customer_initial(bronze: DataFrame, day: date | str, stamp: datetime | None = None) -> DataFrame:
    """First load of the customer dimension, keyed by a hash of the customer id."""
    keyed = R.surrogate_key_hash(bronze, "customer_id", "customer_sk")
    return R.select_schema(R.constant_scd_columns(keyed, day, stamp), S.DIM_CUSTOMER_SCD)


def dim_product(bronze: DataFrame, day: date | str, stamp: datetime | None = None) -> DataFrame:
    """Catalogue as known on ``day``: the last version of each product up to that day."""
    known = bronze.filter(
        F.col("last_updated") < F.date_add(C.day_lit(day), 1).cast("timestamp")
    )
    order = [
        F.col("last_updated").desc(), F.col("ingestion_time").desc_nulls_last(),
        *[F.col(c).asc_nulls_last() for c in ("base_price", "product_name", "brand", "category")],
    ]
    latest = K.latest_per_key(known, ["product_id"], order)
    return R.select_schema(R.constant_scd_columns(latest, day, stamp), S.DIM_PRODUCT)


def latest_campaigns(history: DataFrame) -> DataFrame:
    """Last ingested version of each campaign."""
    order = [
        F.col("ingestion_time").desc_nulls_last(),
        *[F.col(c).asc_nulls_last() for c in ("campaign_name", "start_date", "end_date", "budget")],
    ]
    return K.latest_per_key(history.filter("campaign_id IS NOT NULL"), ["campaign_id"], order)


def dim_campaign(history: DataFrame, stamp: datetime | None = None) -> DataFrame:
    now = (F.lit(stamp) if stamp is not None else F.current_timestamp()).cast("timestamp")
    return R.select_schema(
        latest_campaigns(history).withColumns({"created_time": now, "updated_time": now}),
        S.DIM_MARKETING_CAMPAIGN,
    )


def _calendar(days: DataFrame, holidays: DataFrame | None) -> DataFrame:
    d = F.col("date_id")
    out = days.select(
        d, F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
        F.date_format(d, "EEEE").alias("day_of_week"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"),
        F.weekofyear(d).alias("week_of_year"), F.dayofyear(d).alias("day_of_year"),
    )
    if holidays is not None:
        marked = holidays.select(F.col("date_id").alias("_holiday")).distinct()
        out = out.join(marked, d == F.col("_holiday"), "left").withColumn(
            "is_holiday", F.col("_holiday").isNotNull()
        ).drop("_holiday")
    return R.select_schema(out, S.DIM_DATE)


def _days(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("date_id")


def dim_date(
    spark: SparkSession, start: date | str = "2024-01-01", end: date | str = "2025-12-31",
    holidays: DataFrame | None = None,
) -> DataFrame:
    """Calendar between two days, both included."""
    return _calendar(spark.range(1).select(_days(C.day_lit(start), C.day_lit(end))), holidays)


def dim_date_for(df: DataFrame, ts: str, holidays: DataFrame | None = None) -> DataFrame:
    """Calendar spanning the days found in a table's time column."""
    span = df.agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("b"))
    return _calendar(span.select(_days(F.col("a"), F.col("b"))), holidays)
