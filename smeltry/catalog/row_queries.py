"""Row-local operators over whole derived tables."""

from pyspark.sql import functions as F

from smeltry import schemas as S
from smeltry.catalog.registry import query
from smeltry.catalog.tables import big, day, dbl, each, ts
from smeltry.functions import columns as C
from smeltry.functions.ladders import BATCH_DELAY, CONSUMER_DELAY, MONITOR_DELAY
from smeltry.operators import rows as R

MONITOR_SQL = """CASE WHEN h < 0.1 THEN 'immediate' WHEN h < 1 THEN 'short' WHEN h < 6 THEN 'medium'
  WHEN h < 24 THEN 'long' WHEN h < 48 THEN 'very_long' ELSE 'critical' END"""
CONSUMER_SQL = """CASE WHEN h < 1 THEN 'immediate' WHEN h < 6 THEN 'short' WHEN h < 24 THEN 'medium'
  WHEN h < 48 THEN 'long' ELSE 'critical' END"""
HOURS_SQL = "(epoch_us(ingestion_time) - epoch_us({0})) / 3600000000.0"


@query(
    "require_not_null",
    "SELECT event_id, customer_id, product_id FROM bronze_events WHERE customer_id IS NOT NULL AND product_id IS NOT NULL",
)
def _(w):
    return R.require_not_null(w.bronze_events, ["customer_id", "product_id"]).select(
        "event_id", "customer_id", "product_id"
    )


@query(
    "positive_amount",
    f"SELECT transaction_id, {dbl('amount')}, {big('quantity')} FROM bronze_sales WHERE amount > 0 AND amount < 10000",
)
def _(w):
    return R.positive_amount(w.bronze_sales, "amount", below=10000).select(
        "transaction_id", "amount", "quantity"
    )


@query(
    "business_rules_user_events",
    f"""SELECT event_id, customer_id, event_type, {ts('event_time')} FROM bronze_events
    WHERE customer_id IS NOT NULL AND event_type IS NOT NULL
      AND event_time >= TIMESTAMP '2024-01-01' AND event_time <= TIMESTAMP '2024-01-25 12:00:00'""",
)
def _(w):
    kept = R.business_rules(w.bronze_events, "user_events", until="2024-01-25 12:00:00")
    return kept.select("event_id", "customer_id", "event_type", "event_time")


@query(
    "business_rules_marketplace_sales",
    f"""SELECT transaction_id, {dbl('amount')}, {ts('transaction_time')} FROM bronze_sales
    WHERE amount > 0 AND amount < 10000 AND transaction_time IS NOT NULL""",
)
def _(w):
    return R.business_rules(w.bronze_sales, "marketplace_sales").select(
        "transaction_id", "amount", "transaction_time"
    )


@query(
    "business_rules_customer_data",
    r"SELECT customer_id, email FROM dim_customer_v0 WHERE email IS NOT NULL AND regexp_matches(email, '^[A-Za-z0-9+_.-]+@(.+)$')",
)
def _(w):
    return R.business_rules(w.dim_customer_v0, "customer_data").select("customer_id", "email")


@query(
    "standardize_timestamps",
    "SELECT transaction_id, CASE WHEN currency IS NOT NULL THEN strftime(transaction_time, '%Y-%m-%d %H:%M:%S.%f') END AS transaction_time FROM bronze_sales",
)
def _(w):
    text = F.when(F.col("currency").isNull(), "no time").otherwise(
        F.date_format("transaction_time", "yyyy-MM-dd'T'HH:mm:ss")
    )
    raw = w.bronze_sales.select("transaction_id", text.alias("transaction_time"))
    return R.standardize_timestamps(raw, ["transaction_time", "absent"])


@query(
    "add_audit_columns",
    f"""SELECT event_id, {ts("TIMESTAMP '2024-02-01'", 'processed_time')}, 'bronze_layer' AS data_source,
      '1.0' AS pipeline_version FROM bronze_events""",
)
def _(w):
    stamped = R.add_audit_columns(w.bronze_events.select("event_id"), "2024-02-01 00:00:00")
    return stamped


@query(
    "clean_strings",
    """SELECT p_partkey, nullif(trim('  ' || p_name || ' '), '') AS p_name,
      nullif(trim(CASE WHEN p_size < 10 THEN '   ' ELSE p_brand END), '') AS p_brand FROM part""",
)
def _(w):
    raw = w.table("part").select(
        "p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"),
        F.when(F.col("p_size") < 10, "   ").otherwise(F.col("p_brand")).alias("p_brand"),
    )
    return R.clean_strings(raw, ["p_name", "p_brand"])


@query(
    "to_usd",
    f"""SELECT transaction_id, currency, {dbl('amount', 'amount_original')},
      CAST(amount AS DOUBLE) * CASE currency WHEN 'USD' THEN 1.0::DOUBLE WHEN 'EUR' THEN 1.1::DOUBLE WHEN 'GBP' THEN 1.25::DOUBLE
        WHEN 'CAD' THEN 0.75::DOUBLE WHEN 'AUD' THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END AS amount FROM bronze_sales""",
)
def _(w):
    return R.to_usd(w.bronze_sales.select("transaction_id", "currency", "amount"), ["amount"])


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS o_orderdate_year, CAST(month(o_orderdate) AS BIGINT) AS o_orderdate_month,
      CAST(day(o_orderdate) AS BIGINT) AS o_orderdate_day, CAST(quarter(o_orderdate) AS BIGINT) AS o_orderdate_quarter,
      CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS o_orderdate_dayofweek,
      CAST(weekofyear(o_orderdate) AS BIGINT) AS o_orderdate_weekofyear FROM orders""",
)
def _(w):
    return R.date_parts(w.table("orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "hash_key",
    """SELECT event_id, sha256(coalesce(customer_id, 'NULL') || '_' || coalesce(product_id, 'NULL') || '_' || event_type) AS hash_key
    FROM bronze_events""",
)
def _(w):
    return R.hash_key(w.bronze_events, ["customer_id", "product_id", "event_type"]).select("event_id", "hash_key")


@query(
    "surrogate_key_hash",
    """SELECT count(*) AS customers, count(DISTINCT customer_id) AS keys, TRUE AS non_negative FROM customers""",
)
def _(w):
    keyed = R.surrogate_key_hash(w.customers, "customer_id", "customer_sk")
    return keyed.agg(
        F.count(F.lit(1)).alias("customers"), F.count_distinct("customer_sk").alias("keys"),
        F.bool_and(F.col("customer_sk") >= 0).alias("non_negative"),
    )


@query(
    "lift_map",
    f"""SELECT event_id, product_id AS metadata_product, {dbl('coalesce(time_spent, 0)', 'time_spent_seconds')},
      coalesce(referrer, 'direct') AS referrer FROM bronze_events""",
)
def _(w):
    lifted = R.lift_map(
        w.bronze_events.select("event_id", "metadata"), "metadata",
        {"product_id": ("string", None), "time_spent_seconds": ("decimal(10,2)", 0), "referrer": ("string", "direct")},
    )
    return lifted.withColumnRenamed("product_id", "metadata_product").drop("metadata")


@query(
    "customer_from_seller",
    """SELECT transaction_id, seller_id,
      'CUST-' || lpad(CAST(CAST(regexp_extract(seller_id, '([0-9]+)', 1) AS INTEGER) % 100 + 1 AS VARCHAR), 6, '0') AS customer_id
    FROM bronze_sales""",
)
def _(w):
    return w.bronze_sales.select(
        "transaction_id", "seller_id", C.customer_from_seller(F.col("seller_id")).alias("customer_id")
    )


@query(
    "delay_ladders",
    f"""SELECT event_id, {CONSUMER_SQL} AS consumer, {MONITOR_SQL} AS monitor,
      CASE WHEN h <= 1 THEN 'immediate' WHEN h <= 6 THEN 'slightly_late' WHEN h <= 24 THEN 'late' ELSE 'very_late' END AS batch
    FROM (SELECT event_id, {HOURS_SQL.format('event_time')} AS h FROM bronze_events)""",
)
def _(w):
    hours = w.bronze_events.select(
        "event_id", C.hours_between(F.col("event_time"), F.col("ingestion_time")).alias("h")
    )
    out = hours
    for name, ladder in (("consumer", CONSUMER_DELAY), ("monitor", MONITOR_DELAY), ("batch", BATCH_DELAY)):
        out = R.label(out, "h", ladder, name)
    return out.drop("h")


@query(
    "predicate_filters",
    f"""SELECT event_id, event_type, page_url, device_type, {ts('event_time')} FROM bronze_events
    WHERE event_type IN ('product_view', 'add_to_cart') AND device_type NOT IN ('tablet') AND page_url LIKE '%/app/%'
      AND regexp_matches(customer_id, '^CUST-[0-9]{{6}}$')
      AND event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-25'""",
)
def _(w):
    keep = C.all_of(
        [
            F.col("event_type").isin("product_view", "add_to_cart"), ~F.col("device_type").isin("tablet"),
            F.col("page_url").like("%/app/%"), F.col("customer_id").rlike(C.CUSTOMER_ID),
            C.in_days("event_time", "2024-01-05", "2024-01-24"),
        ]
    )
    return w.bronze_events.filter(keep).select("event_id", "event_type", "page_url", "device_type", "event_time")


@query(
    "fill_defaults",
    "SELECT event_id, coalesce(product_id, 'none') AS product_id, coalesce(customer_id, 'anonymous') AS customer_id FROM bronze_events",
)
def _(w):
    return R.fill_defaults(
        w.bronze_events.select("event_id", "product_id", "customer_id"),
        {"product_id": "none", "customer_id": "anonymous", "absent": 0},
    )


@query(
    "select_schema",
    f"""SELECT sale_id, product_id, CAST(NULL AS BIGINT) AS customer_sk, CAST(NULL AS VARCHAR) AS campaign_id,
      CAST(NULL AS VARCHAR) AS date_id, {big('quantity')}, {each(dbl, 'unit_price', 'total_amount')}, channel,
      {each(ts, 'transaction_time', 'ingestion_time')} FROM silver_sales""",
)
def _(w):
    return R.select_schema(w.silver_sales, S.FACT_SALES)


@query(
    "conform_all_text",
    f"""SELECT product_id, product_name, category, subcategory, brand,
      CASE WHEN base_price > 1000 THEN NULL ELSE CAST(base_price AS DOUBLE) END AS base_price,
      description, is_active, {ts('last_updated')} FROM bronze_products""",
)
def _(w):
    text = w.bronze_products.drop("ingestion_time").select(
        *[F.col(c).cast("string").alias(c) for c in w.bronze_products.columns if c != "ingestion_time"]
    )
    dirty = text.withColumn(
        "base_price",
        F.when(F.col("base_price").cast("double") > 1000, "n/a").otherwise(F.col("base_price")),
    )
    return R.conform(dirty, S.RAW_PRODUCT_CATALOG)


@query(
    "constant_scd_columns",
    f"""SELECT customer_id, '2024-01-01' AS effective_start_date, '9999-12-31' AS effective_end_date, TRUE AS is_current,
      {ts("TIMESTAMP '2024-01-01'", 'created_time')}, {ts("TIMESTAMP '2024-01-01'", 'updated_time')} FROM customers""",
)
def _(w):
    return R.constant_scd_columns(w.customers.select("customer_id"), "2024-01-01", "2024-01-01 00:00:00")


@query(
    "validate_events",
    """SELECT event_id, reject_reason, reject_reason IS NULL AS is_valid FROM (SELECT event_id,
      CASE WHEN customer_id IS NULL THEN 'missing customer_id'
        WHEN event_type NOT IN ('page_view', 'product_view', 'add_to_cart', 'remove_from_cart', 'add_to_wishlist', 'search',
          'filter_apply', 'sort_apply', 'checkout_start', 'purchase_complete', 'user_login', 'user_logout')
        THEN 'invalid event_type' END AS reject_reason FROM bronze_events)""",
)
def _(w):
    return R.validate_event(w.bronze_events).select("event_id", "reject_reason", "is_valid")


@query(
    "validate_sales",
    """SELECT reject_reason, unknown_marketplace, count(*) AS sales FROM (SELECT
      CASE WHEN product_id IS NULL THEN 'missing product_id' WHEN amount <= 0 THEN 'invalid amount' END AS reject_reason,
      marketplace_name NOT IN ('Amazon', 'eBay', 'Shopify', 'Etsy') AS unknown_marketplace
      FROM bronze_sales) GROUP BY ALL""",
)
def _(w):
    checked = R.validate_sale(w.bronze_sales, ("Amazon", "eBay", "Shopify", "Etsy"))
    return checked.groupBy("reject_reason", "unknown_marketplace").agg(F.count(F.lit(1)).alias("sales"))


@query(
    "quarantined_events",
    """SELECT reject_reason, count(*) AS events FROM (SELECT CASE WHEN customer_id IS NULL THEN 'missing customer_id'
      WHEN event_type = 'error' THEN 'invalid event_type' END AS reject_reason FROM bronze_events)
    WHERE reject_reason IS NOT NULL GROUP BY reject_reason""",
)
def _(w):
    _, quarantine = R.split_valid(R.validate_event(w.bronze_events))
    return quarantine.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("events"))


@query(
    "with_delay",
    f"""SELECT event_id, round(h, 6) AS delay_hours, {CONSUMER_SQL} AS delay_category, h > 1 AS is_delayed
    FROM (SELECT event_id, {HOURS_SQL.format('event_time')} AS h FROM bronze_events)""",
)
def _(w):
    d = R.with_delay(w.bronze_events, "event_time", "ingestion_time", CONSUMER_DELAY)
    return d.select("event_id", F.round("delay_hours", 6).alias("delay_hours"), "delay_category", "is_delayed")
