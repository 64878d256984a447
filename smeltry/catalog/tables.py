"""The derived retail tables as SQL common table expressions.

``with_tables`` puts the ones a query mentions in front of it.
"""

from __future__ import annotations

import re

from smeltry.workload import CHANNEL_MAP


def pad(prefix: str, number: str) -> str:
    text = f"CAST({number} AS VARCHAR)"
    return f"'{prefix}' || lpad({text}, CAST(greatest(6, length({text})) AS INTEGER), '0')"


def ts(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {name or column}"


def day(column: str, name: str | None = None) -> str:
    return f"CAST(CAST({column} AS DATE) AS VARCHAR) AS {name or column}"


def dbl(column: str, name: str | None = None) -> str:
    return f"CAST({column} AS DOUBLE) AS {name or column}"


def big(column: str, name: str | None = None) -> str:
    return f"CAST({column} AS BIGINT) AS {name or column}"


def mean(total: str, n: str, digits: int = 2) -> str:
    """Exact half-up mean of an amount with two decimals, in integer arithmetic."""
    up = 10 ** digits
    return f"CAST((2 * CAST({total} * 100 AS HUGEINT) * {up} + 100 * {n}) // (200 * nullif({n}, 0)) AS DOUBLE) / {up}"


def share(part: str, whole: str, digits: int = 4) -> str:
    """Exact half-up ratio of two counts, in integer arithmetic."""
    up = 10 ** digits
    return f"CAST((2 * {up} * CAST({part} AS HUGEINT) + {whole}) // (2 * nullif({whole}, 0)) AS DOUBLE) / {up}"


def each(maker, *columns: str) -> str:
    return ", ".join(maker(c) for c in columns)


SHOPPING = "event_type IN ('view', 'click', 'purchase')"
SALE_AT = "(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(o_orderkey % 30 AS INTEGER)) + to_hours(l_linenumber))"
AMOUNT = "CAST(floor(l_extendedprice / 10) / 100 AS DECIMAL(10,2))"
ATTRS = ("customer_name", "email", "address", "city", "country", "membership_tier")

CTES: dict[str, str] = {
    "bronze_sales": f"""
        SELECT 'TXN-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'Amazon' WHEN '2-HIGH' THEN 'eBay' WHEN '3-MEDIUM' THEN 'Shopify'
            WHEN '4-NOT SPECIFIED' THEN 'Etsy' ELSE 'Walmart' END AS marketplace_name,
          {pad('SELLER-', 'l_suppkey')} AS seller_id,
          CASE WHEN NOT (l_quantity = 49 AND l_linenumber = 7) THEN {pad('PROD-', 'l_partkey')} END AS product_id,
          CAST(CASE WHEN l_returnflag = 'R' AND l_quantity = 50 THEN -{AMOUNT} ELSE {AMOUNT} END AS DECIMAL(10,2)) AS amount,
          CASE WHEN l_linenumber = 6 AND l_quantity = 48 THEN NULL WHEN o_orderstatus = 'O' THEN 'USD'
            WHEN o_orderstatus = 'F' THEN 'EUR' WHEN l_linestatus = 'O' THEN 'GBP' ELSE 'JPY' END AS currency,
          CAST(l_quantity AS INTEGER) AS quantity,
          {SALE_AT} AS transaction_time,
          {SALE_AT} + to_hours(6 * l_linenumber) AS settlement_time,
          CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'paypal' ELSE 'bank_transfer' END AS payment_method,
          CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'pending' END AS status,
          CAST(l_discount AS DECIMAL(5,3)) AS commission_rate,
          CAST(l_quantity AS DECIMAL(8,2)) AS shipping_cost,
          CAST(l_tax AS DECIMAL(8,2)) AS tax_amount,
          {SALE_AT} + to_hours(CAST(l_quantity AS INTEGER)) AS ingestion_time,
          {pad('CUST-', 'o_custkey')} AS buyer_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "raw_events": """
        SELECT event_id AS n, ts AS happened, user_id, event_type, value,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""",
    "bronze_events": f"""
        SELECT n, value, event_type AS kind, k,
          'EVT-' || CAST(n AS VARCHAR) AS event_id,
          'sess_' || CAST(user_id AS VARCHAR) || '_' || strftime(happened, '%Y%m%d') AS session_id,
          CASE WHEN NOT (event_type = 'error' AND k >= 95) THEN {pad('CUST-', 'user_id')} END AS customer_id,
          CASE event_type WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart'
            WHEN 'purchase' THEN 'purchase_complete' WHEN 'signup' THEN 'user_login' ELSE event_type END AS event_type,
          happened AS event_time,
          CASE WHEN n % 2 = 0 THEN '/app/product/' ELSE '/product/' END || CAST(k AS VARCHAR) AS page_url,
          CASE WHEN {SHOPPING} THEN {pad('PROD-', 'k')} END AS product_id,
          CASE user_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_type,
          CASE WHEN event_type IN ('view', 'click') THEN CAST(value AS DECIMAL(10,2)) END AS time_spent,
          CASE WHEN k >= 50 THEN 'search' END AS referrer,
          CASE WHEN event_type = 'purchase' THEN 'cat_' || CAST(k % 6 AS VARCHAR) END AS category,
          happened + to_hours(k) AS ingestion_time
        FROM raw_events""",
    "event_envelope": """
        SELECT *, 'user_activity_events' AS topic, CAST(n % 6 AS INTEGER) AS part,
          CAST(n // 6 AS BIGINT) AS pos, (kind = 'error' AND value < 1) AS broken
        FROM bronze_events""",
    "bronze_products": f"""
        SELECT {pad('PROD-', 'p_partkey')} AS product_id, p_name AS product_name, p_type AS category,
          split_part(p_name, ' ', 1) AS subcategory, p_brand AS brand,
          CAST(p_retailprice AS DECIMAL(10,2)) AS base_price, CAST(NULL AS VARCHAR) AS description,
          TRUE AS is_active, TIMESTAMP '2023-11-01 00:00:00' AS last_updated FROM part
        UNION ALL
        SELECT {pad('PROD-', 'p_partkey')}, p_name, p_type, split_part(p_name, ' ', 1), p_brand,
          CAST(CAST(p_retailprice AS DECIMAL(10,2)) + 1 AS DECIMAL(10,2)), NULL, p_size < 45,
          TIMESTAMP '2023-12-01 00:00:00' + to_days(p_size) FROM part WHERE p_size > 25""",
    "campaign_history": """
        SELECT 'CAMP-' || p_brand AS campaign_id, p_name AS campaign_name, p_type AS campaign_type,
          DATE '2024-01-01' + p_size AS start_date, DATE '2024-01-01' + p_size + 30 AS end_date,
          CAST(p_retailprice AS DECIMAL(15,2)) AS budget,
          CASE WHEN p_size <= 20 THEN 'new' ELSE 'loyal' END AS target_audience,
          TIMESTAMP '2023-12-01 00:00:00' + to_seconds(p_partkey) AS ingestion_time FROM part""",
    "channel_map": "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in CHANNEL_MAP)
    + ") t(campaign_id, sales_channel, channel, customer_segment)",
    "customers": f"""
        SELECT c_custkey, c_acctbal, {pad('CUST-', 'c_custkey')} AS customer_id, c_name AS customer_name,
          lower(replace(c_name, '#', '')) || '@shop.example' AS email,
          'Street ' || CAST(c_nationkey AS VARCHAR) AS address, n_name AS city, r_name AS country,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Silver' WHEN 'MACHINERY' THEN 'Gold'
            WHEN 'HOUSEHOLD' THEN 'Platinum' ELSE 'Bronze' END AS membership_tier
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "dim_customer_v0": """
        SELECT c_custkey + 1 AS customer_sk, customer_id, customer_name,
          CASE WHEN c_acctbal >= 0 THEN email END AS email, address, city, country, membership_tier,
          CASE WHEN c_acctbal > 5000 THEN DATE '2023-07-01' ELSE DATE '2023-01-01' END AS effective_start_date,
          DATE '9999-12-31' AS effective_end_date, TRUE AS is_current,
          TIMESTAMP '2023-01-01 00:00:00' AS updated_time FROM customers
        UNION ALL
        SELECT -(c_custkey + 1), customer_id, customer_name, CASE WHEN c_acctbal >= 0 THEN email END,
          address, city, country, 'Bronze', DATE '2023-01-01', DATE '2023-07-01', FALSE,
          TIMESTAMP '2023-01-01 00:00:00' FROM customers WHERE c_acctbal > 5000""",
    "customer_snapshot": f"""
        SELECT customer_id, customer_name, email,
          CASE WHEN NOT (c_acctbal BETWEEN 7000 AND 7500) THEN address END AS address, city, country,
          CASE WHEN c_acctbal > 8000 THEN 'Platinum' ELSE membership_tier END AS membership_tier,
          TIMESTAMP '2024-01-16 12:00:00' AS last_updated FROM customers WHERE c_acctbal >= -500
        UNION ALL
        SELECT customer_id, customer_name, email, CASE WHEN NOT (c_acctbal BETWEEN 7000 AND 7500) THEN address END,
          city, country, 'Gold', TIMESTAMP '2024-01-16 08:00:00' FROM customers WHERE c_acctbal > 9500
        UNION ALL
        SELECT {pad('CUST-S', 's_suppkey')}, s_name, NULL, 'Street ' || CAST(s_nationkey AS VARCHAR),
          'unknown', 'unknown', 'Bronze', TIMESTAMP '2024-01-16 12:00:00' FROM supplier""",
    "snapshot_latest": """
        SELECT * FROM customer_snapshot
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY last_updated DESC) = 1""",
    "scd_fresh": f"""
        SELECT s.* FROM snapshot_latest s
        LEFT JOIN (SELECT * FROM dim_customer_v0 WHERE is_current) c ON s.customer_id = c.customer_id
        WHERE c.customer_id IS NULL OR {' OR '.join(f's.{a} IS DISTINCT FROM c.{a}' for a in ATTRS)}""",
    "dim_customer": """
        SELECT d.customer_sk, d.customer_id, d.customer_name, d.email, d.address, d.city, d.country,
          d.membership_tier, d.effective_start_date,
          CASE WHEN f.customer_id IS NOT NULL THEN DATE '2024-01-16' ELSE d.effective_end_date END AS effective_end_date,
          d.is_current AND f.customer_id IS NULL AS is_current,
          CASE WHEN f.customer_id IS NOT NULL THEN TIMESTAMP '2024-01-16 00:00:00' ELSE d.updated_time END AS updated_time
        FROM dim_customer_v0 d LEFT JOIN scd_fresh f ON d.customer_id = f.customer_id AND d.is_current
        UNION ALL
        SELECT (SELECT max(customer_sk) FROM dim_customer_v0) + 1 + slot
            + 4096 * (row_number() OVER (PARTITION BY slot ORDER BY digest, customer_id) - 1),
          customer_id, customer_name, email, address, city, country, membership_tier,
          DATE '2024-01-16', DATE '9999-12-31', TRUE, TIMESTAMP '2024-01-16 00:00:00'
        FROM (SELECT *, md5(customer_id) AS digest,
                CAST('0x' || substr(md5(customer_id), 1, 3) AS BIGINT) AS slot FROM scd_fresh)""",
    "silver_events": """
        SELECT event_id, session_id, customer_id, event_type, event_time, page_url, product_id, device_type,
          coalesce(time_spent, 0) AS time_spent_seconds, coalesce(referrer, 'direct') AS referrer,
          CAST(event_time AS DATE) AS ingestion_date
        FROM bronze_events
        WHERE event_id IS NOT NULL AND customer_id IS NOT NULL AND event_type IS NOT NULL AND event_time IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingestion_time DESC, event_time, customer_id, event_type) = 1""",
    "mapped_sales": """
        SELECT *, buyer_id AS customer_id, CASE marketplace_name WHEN 'Amazon' THEN 'website'
          WHEN 'eBay' THEN 'mobile_app' ELSE 'marketplace' END AS channel FROM bronze_sales""",
    "silver_sales": """
        SELECT transaction_id AS sale_id, customer_id, product_id, channel, quantity, amount AS unit_price,
          amount AS total_amount, coalesce(currency, 'USD') AS currency, transaction_time, ingestion_time,
          CAST(transaction_time AS DATE) AS transaction_date
        FROM mapped_sales
        WHERE transaction_id IS NOT NULL AND product_id IS NOT NULL AND amount > 0
        QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY ingestion_time DESC, transaction_time,
          product_id, amount, quantity, customer_id, channel, coalesce(currency, 'USD')) = 1""",
    "dim_product": """
        SELECT product_id, product_name, category, subcategory, brand, base_price, description, is_active
        FROM bronze_products WHERE last_updated < TIMESTAMP '2024-01-16 00:00:00'
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY last_updated DESC) = 1""",
    "dim_campaign": """
        SELECT * FROM campaign_history
        QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY ingestion_time DESC) = 1""",
    "fact_sales": """
        SELECT s.sale_id, s.product_id, c.customer_sk, s.transaction_date AS date_id, s.quantity, s.unit_price,
          s.total_amount, s.channel, s.transaction_time, s.ingestion_time
        FROM silver_sales s LEFT JOIN dim_customer c ON s.customer_id = c.customer_id AND c.is_current
          AND s.transaction_date >= c.effective_start_date
          AND s.transaction_date <= coalesce(c.effective_end_date, DATE '9999-12-31')""",
    "fact_activity": """
        SELECT event_id, customer_id, product_id, CAST(event_time AS DATE) AS date_id, event_type, page_url,
          device_type, event_time, time_spent_seconds, session_id FROM silver_events""",
    "daily_sales": """
        SELECT date_id, channel, sum(total_amount) AS total_revenue, count(DISTINCT sale_id) AS total_transactions,
          count(DISTINCT customer_sk) AS unique_customers FROM fact_sales GROUP BY date_id, channel""",
    "channel_visitors": """
        SELECT date_id, 'website' AS channel, count(DISTINCT customer_id) AS total_visitors FROM fact_activity
        WHERE device_type IN ('desktop', 'mobile', 'tablet') GROUP BY date_id
        UNION ALL
        SELECT date_id, 'mobile_app', count(DISTINCT customer_id) FROM fact_activity
        WHERE device_type = 'mobile' AND page_url LIKE '%/app/%' GROUP BY date_id""",
    "sales_performance": f"""
        SELECT d.date_id, d.channel, d.total_revenue, d.total_transactions, d.unique_customers,
          {mean('d.total_revenue', 'd.total_transactions')} AS avg_transaction_value,
          CASE WHEN v.total_visitors > 0 THEN {share('d.unique_customers', 'v.total_visitors')} ELSE 0.0 END AS conversion_rate
        FROM daily_sales d LEFT JOIN channel_visitors v ON d.date_id = v.date_id AND d.channel = v.channel""",
}


def _needed(text: str, found: list[str]) -> None:
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(body, found)
            if name not in found:
                found.append(name)


def with_tables(sql: str) -> str:
    """The query with every derived table it mentions defined in front of it."""
    found: list[str] = []
    _needed(sql, found)
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in found)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        return f"WITH {head},\n{body}" if head else f"WITH {body}"
    return f"WITH {head}\n{body}" if head else body
