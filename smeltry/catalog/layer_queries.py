"""Silver, dimension and gold plans."""

from pyspark.sql import functions as F

from smeltry.catalog.join_queries import FACT_SQL
from smeltry.catalog.key_queries import CAMPAIGN_SQL
from smeltry.catalog.registry import query
from smeltry.catalog.tables import ATTRS, big, day, dbl, each, mean, ts
from smeltry.plans import dims, gold, silver
from smeltry.workload import SEGMENT_DAY, STAMP

STAMP_SQL = "TIMESTAMP '2024-02-01'"
SCD_COLUMNS = f"""customer_sk, customer_id, {', '.join(ATTRS)}, {each(day, 'effective_start_date', 'effective_end_date')}, is_current, {ts('updated_time')}"""


@query(
    "silver_user_events",
    f"""SELECT event_id, session_id, customer_id, event_type, {ts('event_time')}, page_url, product_id, device_type,
      {dbl('time_spent_seconds')}, referrer, {ts(STAMP_SQL, 'processed_time')}, {day('ingestion_date')} FROM silver_events""",
)
def _(w):
    return w.silver_events


@query(
    "silver_user_events_of_day",
    f"""SELECT event_id, customer_id, product_id, {dbl('time_spent_seconds')}, referrer FROM silver_events WHERE ingestion_date = DATE '2024-01-10'""",
)
def _(w):
    return silver.silver_user_events(w.bronze_events, "2024-01-10", STAMP).select(
        "event_id", "customer_id", "product_id", "time_spent_seconds", "referrer"
    )


SALES_COLUMNS = f"""sale_id, customer_id, product_id, channel, {big('quantity')}, {each(dbl, 'unit_price', 'total_amount')}, currency,
  {each(ts, 'transaction_time', 'ingestion_time')}, {ts(STAMP_SQL, 'processed_time')}, {day('transaction_date')}"""


@query("silver_sales", f"SELECT {SALES_COLUMNS} FROM silver_sales")
def _(w):
    return w.silver_sales


@query(
    "silver_sales_of_day",
    f"""SELECT {SALES_COLUMNS} FROM (SELECT transaction_id AS sale_id,
        'CUST-' || lpad(CAST(CAST(regexp_extract(seller_id, '([0-9]+)', 1) AS INTEGER) % 100 + 1 AS VARCHAR), 6, '0') AS customer_id,
        product_id, marketplace_name AS channel, quantity, amount AS unit_price, amount AS total_amount, coalesce(currency, 'USD') AS currency,
        transaction_time, ingestion_time, CAST(transaction_time AS DATE) AS transaction_date FROM bronze_sales
      WHERE amount > 0 AND product_id IS NOT NULL
        AND (CAST(transaction_time AS DATE) = DATE '2024-01-15' OR CAST(settlement_time AS DATE) = DATE '2024-01-15'))
    QUALIFY row_number() OVER (PARTITION BY sale_id ORDER BY ingestion_time DESC, transaction_time, product_id, total_amount, quantity,
      customer_id, channel, currency) = 1""",
)
def _(w):
    return silver.silver_sales(w.bronze_sales, "2024-01-15", processed=STAMP)


@query(
    "dim_customer_initial",
    f"""SELECT customer_id, customer_name, email, membership_tier, '2024-01-01' AS effective_start_date, '9999-12-31' AS effective_end_date,
      TRUE AS is_current, TRUE AS keyed FROM customers""",
)
def _(w):
    d = dims.dim_customer_initial(w.customers, "2024-01-01", STAMP)
    return d.withColumn("keyed", F.col("customer_sk") >= 0).select(
        "customer_id", "customer_name", "email", "membership_tier", "effective_start_date",
        "effective_end_date", "is_current", "keyed",
    )


@query(
    "dim_product",
    f"""SELECT product_id, product_name, category, subcategory, brand, {dbl('base_price')}, description, is_active, '2024-01-15' AS effective_start_date,
      '9999-12-31' AS effective_end_date, TRUE AS is_current, {ts(STAMP_SQL, 'created_time')}, {ts(STAMP_SQL, 'updated_time')} FROM dim_product""",
)
def _(w):
    return w.dim_product


@query("scd2_apply", f"SELECT {SCD_COLUMNS} FROM dim_customer")
def _(w):
    return w.dim_customer.drop("created_time")


@query("dim_campaign", f"{CAMPAIGN_SQL}, {ts(STAMP_SQL, 'created_time')}, {ts(STAMP_SQL, 'updated_time')} FROM dim_campaign")
def _(w):
    return w.dim_campaign


@query(
    "dim_date",
    f"""SELECT {day('d', 'date_id')}, CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month, CAST(day(d) AS BIGINT) AS day,
      dayname(d) AS day_of_week, dayofweek(d) IN (0, 6) AS is_weekend, d IN (SELECT CAST(min(o_orderdate) AS DATE) FROM orders) AS is_holiday,
      'Q' || CAST(quarter(d) AS VARCHAR) AS quarter, CAST(weekofyear(d) AS BIGINT) AS week_of_year, CAST(dayofyear(d) AS BIGINT) AS day_of_year
    FROM (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d FROM orders)""",
)
def _(w):
    orders = w.table("orders")
    first_day = orders.agg(F.min(F.to_date("o_orderdate")).alias("date_id"))
    return dims.dim_date_for(orders, "o_orderdate", holidays=first_day)


@query("fact_sales_of_day", f"{FACT_SQL} FROM fact_sales WHERE date_id = DATE '2024-01-20'")
def _(w):
    return gold.fact_sales(w.silver_sales, w.dim_customer, "2024-01-20")


@query(
    "fact_user_activity",
    f"""SELECT event_id, customer_id, product_id, {day('date_id')}, event_type, page_url, device_type, {ts('event_time')},
      {dbl('time_spent_seconds')}, session_id FROM fact_activity""",
)
def _(w):
    return w.fact_activity


PERFORMANCE_SQL = f"""SELECT {day('date_id')}, channel, {dbl('total_revenue')}, total_transactions, unique_customers, avg_transaction_value, conversion_rate FROM sales_performance"""


@query("sales_performance", PERFORMANCE_SQL)
def _(w):
    return w.sales_performance


@query("sales_performance_of_day", f"{PERFORMANCE_SQL} WHERE date_id = DATE '2024-01-15'")
def _(w):
    return gold.sales_performance(w.fact_sales, w.fact_activity, "2024-01-15")


@query(
    "campaign_effectiveness",
    f"""SELECT campaign_id, {day('date_id')}, {dbl('spend')}, {dbl('revenue')},
      round((CAST(revenue AS DOUBLE) - CAST(spend AS DOUBLE)) / CAST(spend AS DOUBLE), 4) AS roi, conversions,
      {mean('spend', 'conversions')} AS cost_per_acquisition, channel, customer_segment
    FROM (SELECT m.campaign_id, f.date_id, c.budget AS spend, m.channel, m.customer_segment, sum(f.total_amount) AS revenue, count(DISTINCT f.sale_id) AS conversions
      FROM channel_map m JOIN dim_campaign c ON m.campaign_id = c.campaign_id JOIN fact_sales f ON f.channel = m.sales_channel GROUP BY ALL)""",
)
def _(w):
    return gold.campaign_effectiveness(w.fact_sales, w.dim_campaign, w.channel_map)


@query(
    "customer_segmentation",
    f"""SELECT customer_id,
      CASE WHEN n >= 10 AND a >= 50 THEN 'High Value' WHEN n >= 5 AND a >= 25 THEN 'Medium Value' ELSE 'Low Value' END AS value_segment,
      CASE WHEN d <= 30 THEN 'Active' WHEN d <= 90 THEN 'At Risk' ELSE 'Inactive' END AS activity_status,
      CASE WHEN k >= 3 THEN 'Diverse' WHEN k = 2 THEN 'Focused' ELSE 'Single Category' END AS purchase_diversity,
      {dbl('s', 'total_spend')}, n AS total_transactions, a AS avg_transaction_value, {day('last_day', 'last_purchase_date')},
      d AS days_since_last_purchase, '{SEGMENT_DAY}' AS segment_date
    FROM (SELECT c.customer_id, count(DISTINCT f.sale_id) AS n, sum(f.total_amount) AS s, {mean('sum(f.total_amount)', 'count(f.total_amount)', 6)} AS a,
        max(f.date_id) AS last_day, CAST(date_diff('day', max(f.date_id), DATE '{SEGMENT_DAY}') AS BIGINT) AS d, count(DISTINCT p.category) AS k
      FROM fact_sales f JOIN dim_customer c ON f.customer_sk = c.customer_sk AND c.is_current LEFT JOIN dim_product p ON f.product_id = p.product_id
      WHERE f.date_id <= DATE '{SEGMENT_DAY}' GROUP BY c.customer_sk, c.customer_id)""",
)
def _(w):
    return gold.customer_segmentation(w.fact_sales, w.dim_customer, w.dim_product, SEGMENT_DAY)
