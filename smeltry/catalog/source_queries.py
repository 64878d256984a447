"""Parsing, slicing, and merge-like writes as frames."""

from pyspark.sql import functions as F

from smeltry import schemas as S
from smeltry.catalog.registry import query
from smeltry.catalog.tables import big, day, dbl, each, ts
from smeltry.operators import upsert as U
from smeltry.sources import envelope as E
from smeltry.sources.files import scan_slice


@query(
    "parse_user_events",
    f"""SELECT event_id, session_id, customer_id, event_type, {ts('event_time')}, page_url, product_id, device_type, {ts('ingestion_time')},
      {ts('ingestion_time', 'kafka_timestamp')}, {big('part', 'kafka_partition')}, {big('pos', 'kafka_offset')}
    FROM event_envelope WHERE NOT broken AND customer_id IS NOT NULL""",
)
def _(w):
    return E.parse_user_events(w.event_envelope).drop("metadata")


@query(
    "parse_marketplace_sales",
    f"""SELECT transaction_id, marketplace_name, seller_id, product_id, {dbl('amount')}, currency, {big('quantity')}, {each(ts, 'transaction_time', 'settlement_time')},
      payment_method, status, {ts('ingestion_time')}, {ts('ingestion_time', 'kafka_timestamp')}, {dbl('tax_amount')} FROM bronze_sales WHERE product_id IS NOT NULL""",
)
def _(w):
    parsed = E.parse_marketplace_sales(w.sales_envelope)
    tax = F.col("marketplace_metadata")["tax_amount"].try_cast("decimal(8,2)")
    return parsed.withColumn("tax_amount", tax).drop("marketplace_metadata", "kafka_partition", "kafka_offset")


@query(
    "parse_envelope",
    f"""SELECT CASE WHEN NOT broken THEN event_id END AS event_id, CASE WHEN NOT broken THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') END AS event_time,
      CASE WHEN NOT broken THEN referrer END AS referrer, topic, {big('part', 'partition')}, {big('pos', 'offset')}, {ts('ingestion_time', 'kafka_timestamp')}
    FROM event_envelope""",
)
def _(w):
    parsed = E.parse_envelope(w.event_envelope, S.USER_EVENT_MESSAGE)
    return parsed.select(
        "event_id", "event_time", F.col("metadata")["referrer"].alias("referrer"), "topic", "partition", "offset", "kafka_timestamp"
    )


@query(
    "scan_slice",
    f"""SELECT transaction_id, product_id, {big('quantity')}, {each(ts, 'transaction_time', 'settlement_time')} FROM bronze_sales
    WHERE CAST(transaction_time AS DATE) = DATE '2024-01-15' OR CAST(settlement_time AS DATE) = DATE '2024-01-15'""",
)
def _(w):
    return scan_slice(w.bronze_sales, "transaction_time", "2024-01-15", "settlement_time").select(
        "transaction_id", "product_id", "quantity", "transaction_time", "settlement_time"
    )


ON_TIME = "CAST(event_time AS DATE) = CAST(ingestion_time AS DATE)"


@query(
    "upsert",
    f"""SELECT event_id, event_type, {day('event_time', 'event_date')}, CASE WHEN {ON_TIME} THEN 'kept' ELSE 'late' END AS origin FROM bronze_events""",
)
def _(w):
    cols = ["event_id", "event_type", F.to_date("event_time").alias("event_date")]
    same_day = F.to_date("event_time") == F.to_date("ingestion_time")
    target = w.bronze_events.select(*cols, F.lit("kept").alias("origin"))
    source = w.bronze_events.filter(~same_day).select(*cols, F.lit("late").alias("origin"), "ingestion_time")
    return U.upsert(target, source, ["event_id"], [F.col("ingestion_time").desc()])


@query(
    "replace_slice",
    f"""SELECT sale_id, {dbl('total_amount')}, {day('transaction_date')}, 'kept' AS origin FROM silver_sales
      WHERE transaction_date NOT IN (SELECT transaction_date FROM silver_sales WHERE channel = 'website' AND total_amount > 100)
    UNION ALL SELECT sale_id, {dbl('total_amount * 2', 'total_amount')}, {day('transaction_date')}, 'fresh' FROM silver_sales
      WHERE channel = 'website' AND total_amount > 100""",
)
def _(w):
    target = w.silver_sales.select("sale_id", "total_amount", "transaction_date", F.lit("kept").alias("origin"))
    fresh = w.silver_sales.filter("channel = 'website' AND total_amount > 100").select(
        "sale_id", (F.col("total_amount") * 2).cast("decimal(10,2)").alias("total_amount"),
        "transaction_date", F.lit("fresh").alias("origin"),
    )
    return U.replace_slice(target, fresh, "transaction_date")


@query(
    "upsert_null_keys",
    f"""SELECT NULL AS event_id, event_type, {day('event_time', 'event_date')}, 'late' AS origin FROM bronze_events WHERE NOT ({ON_TIME})
    UNION ALL SELECT event_id, event_type, {day('event_time', 'event_date')}, 'kept' FROM bronze_events""",
)
def _(w):
    cols = ["event_type", F.to_date("event_time").alias("event_date")]
    same_day = F.to_date("event_time") == F.to_date("ingestion_time")
    target = w.bronze_events.select("event_id", *cols, F.lit("kept").alias("origin"))
    source = w.bronze_events.filter(~same_day).select(
        F.lit(None).cast("string").alias("event_id"), *cols, F.lit("late").alias("origin"), "ingestion_time"
    )
    return U.upsert(target, source, ["event_id"], [F.col("ingestion_time").desc()])


@query(
    "replace_slice_emptied",
    f"""SELECT sale_id, {dbl('total_amount')}, {day('transaction_date')} FROM silver_sales
      WHERE NOT coalesce(transaction_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12', FALSE)
    UNION ALL SELECT sale_id, {dbl('total_amount')}, {day('transaction_date')} FROM silver_sales WHERE transaction_date = DATE '2024-01-11'""",
)
def _(w):
    target = w.silver_sales.select("sale_id", "total_amount", "transaction_date")
    dates = target.select("transaction_date").filter("transaction_date BETWEEN '2024-01-10' AND '2024-01-12'")
    return U.replace_slice(target, target.filter("transaction_date = '2024-01-11'"), "transaction_date", dates)
