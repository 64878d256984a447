"""Late arrivals in batch."""

from pyspark.sql import functions as F

from smeltry.catalog.registry import query
from smeltry.catalog.tables import big, day, dbl, each, ts
from smeltry.plans import late, silver
from smeltry.workload import STAMP

DAY = "2024-01-16"
CUTOFF = "2024-01-16 00:00:00"

LATE_SQL = f"""SELECT *, round((epoch(ingestion_time) - epoch(transaction_time)) / 3600.0, 2) AS h, CAST(transaction_time AS DATE) AS event_date
  FROM bronze_sales WHERE CAST(ingestion_time AS DATE) = DATE '{DAY}'
    AND transaction_time >= TIMESTAMP '{DAY}' - INTERVAL 48 HOUR AND transaction_time < TIMESTAMP '{DAY}'"""

BEFORE_SQL = f"""SELECT transaction_id AS sale_id, customer_id, product_id, channel, amount AS total_amount, quantity, CAST(transaction_time AS DATE) AS transaction_date
  FROM mapped_sales WHERE ingestion_time < TIMESTAMP '{CUTOFF}' AND transaction_id IS NOT NULL AND product_id IS NOT NULL AND amount > 0
  QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY ingestion_time DESC, transaction_time,
    product_id, amount, quantity, customer_id, channel, coalesce(currency, 'USD')) = 1"""

REPAIRED_SQL = f"""SELECT sale_id, customer_id, product_id, channel, total_amount, quantity, transaction_date FROM ({BEFORE_SQL})
    WHERE transaction_date NOT IN (SELECT event_date FROM ({LATE_SQL}))
  UNION ALL SELECT sale_id, customer_id, product_id, channel, total_amount, quantity, transaction_date FROM silver_sales
    WHERE transaction_date IN (SELECT event_date FROM ({LATE_SQL}))"""

REPAIRED_COLUMNS = ["sale_id", "customer_id", "product_id", "channel", "total_amount", "quantity", "transaction_date"]


def _before(w):
    """Silver as loaded before the cut-off."""
    seen = w.bronze_sales.filter(F.col("ingestion_time") < F.lit(CUTOFF).cast("timestamp"))
    return silver.silver_sales(seen, customer=F.col("buyer_id"), channel=w.channel, processed=STAMP)


@query(
    "late_arrivals",
    f"""SELECT transaction_id, marketplace_name, product_id, {each(ts, 'transaction_time', 'ingestion_time')}, h AS arrival_delay_hours, {day('event_date')},
      CASE WHEN h <= 1 THEN 'immediate' WHEN h <= 6 THEN 'slightly_late' WHEN h <= 24 THEN 'late' ELSE 'very_late' END AS arrival_category FROM ({LATE_SQL})""",
)
def _(w):
    return late.late_arrivals(w.bronze_sales, DAY, 48).select(
        "transaction_id", "marketplace_name", "product_id", "transaction_time", "ingestion_time",
        "arrival_delay_hours", "event_date", "arrival_category",
    )


@query(
    "late_since_cutoff",
    f"""SELECT event_id, {each(ts, 'event_time', 'ingestion_time')} FROM bronze_events
    WHERE ingestion_time > TIMESTAMP '{CUTOFF}' AND event_time < TIMESTAMP '{CUTOFF}'""",
)
def _(w):
    return late.late_since_cutoff(w.bronze_events, CUTOFF).select("event_id", "event_time", "ingestion_time")


@query(
    "late_report",
    f"""SELECT 'user_events' AS source, count(*) AS late_rows FROM bronze_events
      WHERE ingestion_time > TIMESTAMP '{CUTOFF}' AND event_time < TIMESTAMP '{CUTOFF}'
    UNION ALL SELECT 'marketplace_sales', count(*) FROM bronze_sales
      WHERE ingestion_time > TIMESTAMP '{CUTOFF}' AND transaction_time < TIMESTAMP '{CUTOFF}'""",
)
def _(w):
    return late.late_report(
        [("user_events", w.bronze_events, "event_time"), ("marketplace_sales", w.bronze_sales, "transaction_time")], CUTOFF
    )


@query(
    "transform_late_events",
    f"""SELECT event_id, session_id, customer_id, event_type, {ts('event_time', 'event_timestamp')}, page_url, device_type, product_id, category,
      strftime(event_time, '%Y-%m-%d') AS event_date, CAST(hour(event_time) AS BIGINT) AS event_hour, {ts("TIMESTAMP '2024-02-01'", 'processed_at')}
    FROM bronze_events""",
)
def _(w):
    return silver.late_user_events(w.bronze_events, STAMP)


@query(
    "transform_late_sales",
    f"""SELECT transaction_id, marketplace_name, seller_id, product_id, {dbl('amount')}, currency, {big('quantity')},
      {ts('transaction_time', 'transaction_timestamp')}, {ts('settlement_time', 'settlement_timestamp')}, payment_method, status,
      {each(dbl, 'commission_rate', 'shipping_cost', 'tax_amount')}, strftime(transaction_time, '%Y-%m-%d') AS transaction_date,
      {ts("TIMESTAMP '2024-02-01'", 'processed_at')} FROM bronze_sales""",
)
def _(w):
    return silver.late_marketplace_sales(w.bronze_sales, STAMP)


@query("affected_dates", f"SELECT DISTINCT {day('event_date')} FROM ({LATE_SQL})")
def _(w):
    return late.affected_dates(late.late_rows(w.bronze_sales, DAY, 48))


REPAIRED_OUT = f"""SELECT sale_id, customer_id, product_id, channel, {dbl('total_amount')}, {big('quantity')}, {day('transaction_date')} FROM ({REPAIRED_SQL})"""


@query("reprocess_dates", REPAIRED_OUT)
def _(w):
    dates = late.affected_dates(late.late_rows(w.bronze_sales, DAY, 48))
    return late.reprocess(
        w.bronze_sales, _before(w), dates, F.col("buyer_id"), w.channel, STAMP
    ).select(*REPAIRED_COLUMNS)


@query("late_repair", REPAIRED_OUT)
def _(w):
    run = late.late_repair(w.bronze_sales, _before(w), DAY, 48, F.col("buyer_id"), w.channel, STAMP)
    return run.silver.select(*REPAIRED_COLUMNS)


@query(
    "reconcile_layers",
    f"""WITH b AS (SELECT DISTINCT transaction_id AS id FROM bronze_sales), s AS (SELECT DISTINCT sale_id AS id FROM ({BEFORE_SQL}))
    SELECT (SELECT count(*) FROM b) AS bronze_count, (SELECT count(*) FROM s) AS silver_count,
      (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM s)) AS missing_in_silver,
      (SELECT count(*) FROM s WHERE id NOT IN (SELECT id FROM b)) AS missing_in_bronze,
      (SELECT count(*) FROM b) = (SELECT count(*) FROM s) AS consistent""",
)
def _(w):
    return late.reconcile(w.bronze_sales, _before(w))


RANGE = f"transaction_time >= TIMESTAMP '{DAY}' - INTERVAL 48 HOUR AND transaction_time < TIMESTAMP '{DAY}'"


@query(
    "late_repair_reconciliation",
    f"""WITH b AS (SELECT DISTINCT transaction_id AS id FROM bronze_sales WHERE {RANGE}),
      s AS (SELECT DISTINCT sale_id AS id FROM silver_sales WHERE {RANGE})
    SELECT (SELECT count(*) FROM b) AS bronze_count, (SELECT count(*) FROM s) AS silver_count,
      (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM s)) AS missing_in_silver,
      (SELECT count(*) FROM s WHERE id NOT IN (SELECT id FROM b)) AS missing_in_bronze,
      (SELECT count(*) FROM b) = (SELECT count(*) FROM s) AS consistent""",
)
def _(w):
    run = late.late_repair(w.bronze_sales, _before(w), DAY, 48, F.col("buyer_id"), w.channel, STAMP)
    return run.reconciliation


