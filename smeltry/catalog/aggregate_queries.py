"""Aggregations."""

from itertools import combinations

from pyspark.sql import functions as F

from smeltry.catalog.registry import query
from smeltry.catalog.tables import day, dbl, mean, share
from smeltry.operators import aggregates as A
from smeltry.operators import bitmaps as B
from smeltry.plans import features, gold, late

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DELAY_SQL = """SELECT *, round((epoch(ingestion_time) - epoch(transaction_time)) / 3600.0, 2) AS h, CAST(transaction_time AS DATE) AS event_date
  FROM bronze_sales WHERE CAST(transaction_time AS DATE) <> CAST(ingestion_time AS DATE)"""


@query(
    "daily_channel_sales",
    f"""SELECT {day('date_id')}, channel, {dbl('total_revenue')}, total_transactions, unique_customers FROM daily_sales""",
)
def _(w):
    return gold.daily_channel_sales(w.fact_sales)


@query("channel_visitors", f"SELECT {day('date_id')}, channel, total_visitors FROM channel_visitors")
def _(w):
    return gold.channel_visitors(w.fact_activity)


@query(
    "weekly_visitors",
    f"""SELECT {day("date_trunc('week', date_id)", 'week')}, channel, count(DISTINCT customer_id) AS total_visitors FROM (
      SELECT date_id, customer_id, 'website' AS channel FROM fact_activity WHERE device_type IN ('desktop', 'mobile', 'tablet')
      UNION ALL SELECT date_id, customer_id, 'mobile_app' FROM fact_activity WHERE device_type = 'mobile' AND page_url LIKE '%/app/%')
    WHERE customer_id IS NOT NULL GROUP BY ALL""",
)
def _(w):
    # bitmaps of days, as they would be stored, are merged by week
    days = gold.visitor_bitmaps(w.fact_activity, B.number_keys(w.fact_activity, "customer_id"))
    weekly = days.withColumn("week", F.date_trunc("week", "date_id").cast("date"))
    return gold.visitors_of(weekly, ["week", "channel"])


@query(
    "channel_totals",
    f"""SELECT channel, {dbl('sum(total_amount)', 'revenue')}, count(DISTINCT sale_id) AS conversions FROM fact_sales GROUP BY channel
    UNION ALL SELECT 'all', {dbl('sum(total_amount)', 'revenue')}, count(DISTINCT sale_id) FROM fact_sales""",
)
def _(w):
    totals = {"revenue": F.sum("total_amount"), "conversions": F.count_distinct("sale_id")}
    per = A.metrics_by(w.fact_sales, ["channel"], totals)
    everything = w.fact_sales.agg(*[c.alias(n) for n, c in totals.items()]).withColumn("channel", F.lit("all"))
    return per.unionByName(everything)


@query(
    "customer_metrics",
    f"""SELECT f.customer_sk, count(DISTINCT f.sale_id) AS total_transactions, {dbl('sum(f.total_amount)', 'total_spend')},
      {day('max(f.date_id)', 'last_purchase_date')}, {mean('sum(f.total_amount)', 'count(f.total_amount)', 6)} AS avg_transaction_value,
      count(DISTINCT p.category) AS unique_categories
    FROM fact_sales f LEFT JOIN dim_product p ON f.product_id = p.product_id WHERE f.customer_sk IS NOT NULL GROUP BY f.customer_sk""",
)
def _(w):
    return gold.customer_metrics(w.fact_sales, w.dim_product)


@query(
    "delay_stats",
    f"""SELECT CASE WHEN h <= 1 THEN 'immediate' WHEN h <= 6 THEN 'slightly_late' WHEN h <= 24 THEN 'late' ELSE 'very_late' END AS arrival_category,
      count(*) AS count, round(avg(h), 6) AS avg_delay_hours, max(h) AS max_delay_hours, min(h) AS min_delay_hours
    FROM ({DELAY_SQL}) GROUP BY 1""",
)
def _(w):
    stats = late.delay_stats(late.with_arrival_delay(w.bronze_sales).filter("is_late_arrival"))
    return stats.withColumn("avg_delay_hours", F.round("avg_delay_hours", 6))


@query(
    "reprocessing_summary",
    f"""SELECT count(*) AS total_late_arrivals, count(DISTINCT marketplace_name) AS affected_marketplaces,
      count(DISTINCT event_date) AS affected_dates, round(avg(h), 6) AS avg_delay_hours, max(h) AS max_delay_hours,
      '2024-01-31' AS process_date FROM ({DELAY_SQL})""",
)
def _(w):
    marked = late.with_arrival_delay(w.bronze_sales).filter("is_late_arrival")
    return late.reprocessing_summary(marked, "2024-01-31").withColumn(
        "avg_delay_hours", F.round("avg_delay_hours", 6)
    )


@query(
    "null_tallies",
    """SELECT count(*) FILTER (WHERE event_id IS NULL) AS null_event_id, count(*) FILTER (WHERE customer_id IS NULL) AS null_customer_id,
      count(*) FILTER (WHERE product_id IS NULL) AS null_product_id FROM bronze_events""",
)
def _(w):
    return A.null_tallies(w.bronze_events, ["event_id", "customer_id", "product_id"])


@query(
    "quartiles",
    """SELECT quantile_disc(l_quantity, 0.25) AS l_quantity_q1, quantile_disc(l_quantity, 0.75) AS l_quantity_q3,
      quantile_disc(l_extendedprice, 0.25) AS l_extendedprice_q1, quantile_disc(l_extendedprice, 0.75) AS l_extendedprice_q3 FROM lineitem""",
)
def _(w):
    return A.exact_quantiles(w.table("lineitem"), ["l_quantity", "l_extendedprice"])


@query(
    "describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS stddev,
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem""" for c in LINE
    ),
)
def _(w):
    return A.describe(w.table("lineitem"), LINE).withColumns(
        {c: F.round(c, 4) for c in ("mean", "stddev")}
    )


@query(
    "correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS r FROM lineitem"
        for a, b in combinations(LINE, 2)
    ),
)
def _(w):
    return A.correlations(w.table("lineitem"), LINE, above=-1.0)


@query(
    "base_pairs",
    """SELECT DISTINCT customer_id, product_id FROM silver_events WHERE customer_id IS NOT NULL AND product_id IS NOT NULL
      AND ingestion_date BETWEEN DATE '2024-01-15' - 90 AND DATE '2024-01-15'""",
)
def _(w):
    return features.base_pairs(w.silver_events, "2024-01-15")


@query(
    "popularity_in_category",
    f"""SELECT product_id, category, n AS recent_purchases,
      CASE WHEN max(n) OVER (PARTITION BY category) > 0 THEN {share('n', 'max(n) OVER (PARTITION BY category)')} ELSE 0.0 END AS product_popularity_score
    FROM (SELECT p.product_id, p.category, count(s.sale_id) AS n FROM dim_product p LEFT JOIN silver_sales s
      ON p.product_id = s.product_id AND s.transaction_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY p.product_id, p.category)""",
)
def _(w):
    recent = features.recent_purchases(w.silver_sales, w.dim_product, "2024-01-31")
    return A.share_of_group_max(recent, "category", "recent_purchases", "product_popularity_score").drop("base_price")


@query(
    "category_share",
    f"""SELECT s.customer_id, p.category, count(*) AS category_purchase_count,
      {share('count(*)', 'sum(count(*)) OVER (PARTITION BY s.customer_id)')} AS category_affinity_score
    FROM silver_sales s JOIN dim_product p ON s.product_id = p.product_id
    WHERE s.transaction_date BETWEEN DATE '2024-01-31' - 90 AND DATE '2024-01-31' GROUP BY s.customer_id, p.category""",
)
def _(w):
    return features.category_affinity(w.silver_sales, w.dim_product, "2024-01-31")
