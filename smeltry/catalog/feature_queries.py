"""Point-in-time features."""

from smeltry.catalog.registry import query
from smeltry.catalog.tables import mean, share
from smeltry.plans import features
from smeltry.workload import FEATURE_DAY, STAMP

VIEWS = "count(*) FILTER (WHERE event_type = 'product_view')"
D = f"DATE '{FEATURE_DAY}'"

RECENCY_SQL = f"""
  SELECT customer_id, product_id,
    count(*) FILTER (WHERE event_type = 'product_view' AND ago <= 7) AS view_count_7d,
    count(*) FILTER (WHERE event_type = 'product_view' AND ago <= 30) AS view_count_30d,
    count(*) FILTER (WHERE event_type = 'product_view' AND ago <= 90) AS view_count_90d,
    count(*) FILTER (WHERE event_type = 'add_to_cart' AND ago <= 7) AS cart_add_count_7d,
    count(*) FILTER (WHERE event_type = 'add_to_cart' AND ago <= 30) AS cart_add_count_30d,
    {mean("sum(time_spent_seconds) FILTER (WHERE event_type = 'product_view')", VIEWS)} AS avg_time_spent_seconds,
    CAST(min(ago) AS BIGINT) AS last_interaction_days_ago,
    bool_or(event_type = 'add_to_cart') AND NOT bool_or(event_type = 'purchase_complete') AS cart_abandon_flag,
    {share(VIEWS, 'count(*)')} AS image_view_ratio
  FROM (SELECT *, date_diff('day', ingestion_date, {D}) AS ago FROM silver_events
    WHERE ingestion_date BETWEEN {D} - 90 AND {D} AND customer_id IS NOT NULL AND product_id IS NOT NULL)
  GROUP BY customer_id, product_id"""

FREQUENCY_SQL = f"""
  SELECT customer_id, product_id, count(*) FILTER (WHERE date_diff('day', transaction_date, {D}) <= 7) AS purchase_count_7d,
    count(*) AS purchase_count_30d FROM silver_sales WHERE transaction_date BETWEEN {D} - 30 AND {D} GROUP BY customer_id, product_id"""

AFFINITY_SQL = f"""
  SELECT s.customer_id, p.category, count(*) AS category_purchase_count,
    {share('count(*)', 'sum(count(*)) OVER (PARTITION BY s.customer_id)')} AS category_affinity_score
  FROM silver_sales s JOIN dim_product p ON s.product_id = p.product_id
  WHERE s.transaction_date BETWEEN {D} - 90 AND {D} GROUP BY s.customer_id, p.category"""

CUSTOMER_SQL = f"""
  SELECT customer_id, CAST(date_diff('day', min(transaction_date), {D}) AS BIGINT) AS customer_tenure_days, count(*) AS customer_total_purchases,
    {mean('sum(total_amount)', 'count(*)')} AS customer_avg_order_value
  FROM silver_sales WHERE transaction_date <= {D} GROUP BY customer_id"""

PRODUCT_SQL = f"""
  SELECT product_id, CASE WHEN max(n) OVER (PARTITION BY category) > 0 THEN {share('n', 'max(n) OVER (PARTITION BY category)')} ELSE 0.0 END AS product_popularity_score,
    row_number() OVER (PARTITION BY category ORDER BY base_price DESC, product_id) AS product_price_rank_in_category
  FROM (SELECT p.product_id, p.category, p.base_price, count(s.sale_id) AS n FROM dim_product p LEFT JOIN silver_sales s
    ON p.product_id = s.product_id AND s.transaction_date BETWEEN {D} - 30 AND {D} GROUP BY ALL)"""

RATINGS_SQL = """SELECT 'PROD-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(6, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS product_id,
    CAST(round(1 + p_size / 12.5, 2) AS DOUBLE) AS rating FROM part WHERE p_size <= 40"""

LABEL_SQL = f"""
  SELECT customer_id, product_id, min(transaction_date) <= {D} + 7 AS purchased_next_7d, TRUE AS purchased_next_30d
  FROM silver_sales WHERE transaction_date >= {D} AND transaction_date < {D} + 30 GROUP BY customer_id, product_id"""

STRICT_SQL = f"""
  SELECT customer_id, product_id, min(transaction_date) <= {D} + 7 AS purchased_next_7d, TRUE AS purchased_next_30d
  FROM silver_sales WHERE transaction_date > {D} AND transaction_date <= {D} + 30 GROUP BY customer_id, product_id"""


@query("recency_features", RECENCY_SQL)
def _(w):
    return features.recency_features(w.silver_events, FEATURE_DAY, image_view_ratio=True)


@query("frequency_features", FREQUENCY_SQL)
def _(w):
    return features.frequency_features(w.silver_sales, FEATURE_DAY)


@query(
    "category_affinity_of_pairs",
    f"""WITH affinity AS ({AFFINITY_SQL}), pairs AS (SELECT DISTINCT customer_id, product_id FROM silver_events
      WHERE customer_id IS NOT NULL AND product_id IS NOT NULL AND ingestion_date BETWEEN {D} - 90 AND {D})
    SELECT b.customer_id, b.product_id, a.category_purchase_count, a.category_affinity_score FROM pairs b
    JOIN dim_product p ON b.product_id = p.product_id JOIN affinity a ON a.customer_id = b.customer_id AND a.category = p.category""",
)
def _(w):
    return features.affinity_for_pairs(
        features.category_affinity(w.silver_sales, w.dim_product, FEATURE_DAY),
        features.base_pairs(w.silver_events, FEATURE_DAY), w.dim_product,
    )


@query("customer_features", CUSTOMER_SQL)
def _(w):
    return features.customer_features(w.silver_sales, FEATURE_DAY)


def _ratings(w):
    from pyspark.sql import functions as F

    from smeltry.workload import _id

    return w.table("part").filter("p_size <= 40").select(
        _id("PROD-", "p_partkey").alias("product_id"),
        F.round(1 + F.col("p_size") / F.lit(12.5), 2).alias("product_avg_rating"),
    )


@query(
    "product_features",
    f"""SELECT f.product_id, f.product_popularity_score, coalesce(r.rating, 3.0) AS product_avg_rating, f.product_price_rank_in_category
    FROM ({PRODUCT_SQL}) f LEFT JOIN ({RATINGS_SQL}) r ON f.product_id = r.product_id""",
)
def _(w):
    return features.product_features(w.silver_sales, w.dim_product, FEATURE_DAY, _ratings(w))


@query("purchase_labels", LABEL_SQL)
def _(w):
    return features.purchase_labels(w.silver_sales, FEATURE_DAY)


@query("purchase_labels_strict", STRICT_SQL)
def _(w):
    return features.purchase_labels(w.silver_sales, FEATURE_DAY, strict=True)


FEATURE_TABLE_SQL = f"""WITH r AS ({RECENCY_SQL}), f AS ({FREQUENCY_SQL}), a AS ({AFFINITY_SQL}), c AS ({CUSTOMER_SQL}), p AS ({PRODUCT_SQL}), l AS ({LABEL_SQL})
    SELECT r.customer_id, r.product_id, r.view_count_7d, r.view_count_30d, r.view_count_90d, coalesce(f.purchase_count_7d, 0) AS purchase_count_7d,
      coalesce(f.purchase_count_30d, 0) AS purchase_count_30d, r.cart_add_count_7d, r.cart_add_count_30d, coalesce(r.avg_time_spent_seconds, 0.0) AS avg_time_spent_seconds,
      r.cart_abandon_flag, r.last_interaction_days_ago, coalesce(a.category_purchase_count, 0) AS category_purchase_count,
      coalesce(a.category_affinity_score, 0.0) AS category_affinity_score, coalesce(c.customer_tenure_days, 0) AS customer_tenure_days,
      coalesce(c.customer_total_purchases, 0) AS customer_total_purchases, coalesce(c.customer_avg_order_value, 0.0) AS customer_avg_order_value,
      coalesce(p.product_popularity_score, 0.0) AS product_popularity_score, CAST(3.0 AS DOUBLE) AS product_avg_rating,
      coalesce(p.product_price_rank_in_category, 999) AS product_price_rank_in_category, coalesce(l.purchased_next_7d, FALSE) AS purchased_next_7d,
      coalesce(l.purchased_next_30d, FALSE) AS purchased_next_30d, '{FEATURE_DAY}' AS feature_date, '2024-02-01 00:00:00.000000' AS created_time
    FROM r LEFT JOIN f ON r.customer_id = f.customer_id AND r.product_id = f.product_id LEFT JOIN dim_product d ON r.product_id = d.product_id
    LEFT JOIN a ON a.customer_id = r.customer_id AND a.category = d.category LEFT JOIN c ON c.customer_id = r.customer_id
    LEFT JOIN p ON p.product_id = r.product_id LEFT JOIN l ON l.customer_id = r.customer_id AND l.product_id = r.product_id"""


@query("feature_table", FEATURE_TABLE_SQL)
def feature_table(w):
    return features.feature_table(
        w.silver_events, w.silver_sales, w.dim_product, FEATURE_DAY, stamp=STAMP
    )
