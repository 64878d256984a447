"""Bronze to silver: cleaned, typed, deduplicated tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smeltry import schemas as S
from smeltry.functions import columns as C
from smeltry.operators import keys as K
from smeltry.operators import rows as R
from smeltry.sources.files import scan_slice


def _stamp(at: datetime | None) -> Column:
    return (F.lit(at) if at is not None else F.current_timestamp()).cast("timestamp")


def silver_user_events(bronze: DataFrame, day: date | str | None = None, processed: datetime | None = None) -> DataFrame:
    """Events of a day (or all): metadata lifted, incomplete rows dropped, one row per event.

    Of several copies of an event the last ingested survives.
    """
    shaped = scan_slice(bronze, "event_time", day).select(
        "event_id", "session_id", "customer_id", "event_type",
        F.col("event_time").try_cast("timestamp").alias("event_time"),
        "page_url",
        C.from_map("metadata", "product_id").alias("product_id"),
        "device_type",
        C.from_map("metadata", "time_spent_seconds", "decimal(10,2)", 0).alias("time_spent_seconds"),
        C.from_map("metadata", "referrer", default="direct").alias("referrer"),
        F.to_date("event_time").alias("ingestion_date"),
        F.col("ingestion_time").alias("_ingested"),
    )
    complete = R.require_not_null(shaped, ["event_id", "customer_id", "event_type", "event_time"])
    ties = [
        "event_time", "customer_id", "event_type", "session_id", "page_url", "product_id",
        "device_type", "time_spent_seconds", "referrer",
    ]
    one = K.dedupe(
        complete, ["event_id"],
        [F.col("_ingested").desc_nulls_last()] + [F.col(c).asc_nulls_last() for c in ties],
    )
    return R.select_schema(
        one.withColumn("processed_time", _stamp(processed)), S.STANDARDIZED_USER_EVENTS
    )


def silver_sales(
    bronze: DataFrame, day: date | str | None = None, customer: Column | None = None,
    channel: Column | None = None, processed: datetime | None = None, by_settlement: bool = True,
) -> DataFrame:
    """Sales of a day (or all) by transaction or settlement day, positive and complete, one per id.

    ``customer`` and ``channel`` say how a marketplace row maps to a customer and
    a sales channel; by default from the seller's digits and the marketplace.
    """
    also = "settlement_time" if by_settlement else None
    shaped = scan_slice(bronze, "transaction_time", day, also).select(
        F.col("transaction_id").alias("sale_id"),
        (customer if customer is not None else C.customer_from_seller(F.col("seller_id"))).alias("customer_id"),
        "product_id",
        (channel if channel is not None else F.col("marketplace_name")).alias("channel"),
        F.col("quantity").cast("int").alias("quantity"),
        F.col("amount").alias("unit_price"),
        F.col("amount").alias("total_amount"),
        F.coalesce("currency", F.lit("USD")).alias("currency"),
        F.col("transaction_time").try_cast("timestamp").alias("transaction_time"),
        F.col("ingestion_time").try_cast("timestamp").alias("ingestion_time"),
        F.to_date("transaction_time").alias("transaction_date"),
    )
    complete = R.require_not_null(
        R.positive_amount(shaped, "total_amount"), ["sale_id", "product_id", "transaction_time"]
    )
    ties = ["transaction_time", "product_id", "total_amount", "quantity", "customer_id", "channel", "currency"]
    one = K.dedupe(
        complete, ["sale_id"],
        [F.col("ingestion_time").desc_nulls_last()] + [F.col(c).asc_nulls_last() for c in ties],
    )
    return R.select_schema(one.withColumn("processed_time", _stamp(processed)), S.STANDARDIZED_SALES)


def late_user_events(late: DataFrame, processed: datetime | None = None) -> DataFrame:
    """Late events in the shape of the upserted silver table."""
    shaped = late.withColumns(
        {
            "event_timestamp": F.col("event_time").try_cast("timestamp"),
            "product_id": C.from_map("metadata", "product_id"),
            "category": C.from_map("metadata", "category"),
        }
    ).filter("event_timestamp IS NOT NULL").withColumns(
        {
            "event_date": F.date_format("event_timestamp", "yyyy-MM-dd"),
            "event_hour": F.hour("event_timestamp"),
            "processed_at": _stamp(processed),
        }
    )
    return R.select_schema(shaped, S.LATE_USER_EVENTS)


def late_marketplace_sales(late: DataFrame, processed: datetime | None = None) -> DataFrame:
    """Late sales in the shape of the upserted silver table."""
    shaped = late.withColumns(
        {
            "transaction_timestamp": F.col("transaction_time").try_cast("timestamp"),
            "settlement_timestamp": F.col("settlement_time").try_cast("timestamp"),
            "commission_rate": C.from_map("marketplace_metadata", "commission_rate", "decimal(5,3)"),
            "shipping_cost": C.from_map("marketplace_metadata", "shipping_cost", "decimal(8,2)"),
            "tax_amount": C.from_map("marketplace_metadata", "tax_amount", "decimal(8,2)"),
        }
    ).filter("transaction_timestamp IS NOT NULL").withColumns(
        {
            "transaction_date": F.date_format("transaction_timestamp", "yyyy-MM-dd"),
            "processed_at": _stamp(processed),
        }
    )
    return R.select_schema(shaped, S.LATE_MARKETPLACE_SALES)
