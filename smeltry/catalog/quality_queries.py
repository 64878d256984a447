"""Checks, expectations and roll-ups."""

from pyspark.sql import functions as F

from smeltry.catalog.feature_queries import FEATURE_TABLE_SQL, feature_table
from smeltry.catalog.registry import query
from smeltry.catalog.tables import big, day, dbl
from smeltry.plans import gold
from smeltry.quality import checks as Q
from smeltry.quality import counters as K
from smeltry.quality import expectations as X
from smeltry.quality import rollup as U
from smeltry.quality import rules as Rl

FAIL = "CASE WHEN v > {0} THEN 'FAIL' ELSE 'PASS' END"
WARN = "CASE WHEN v > {0} THEN 'WARN' ELSE 'PASS' END"


def row(src, table, check, column, metric, agg, status, threshold="NULL"):
    """One result row as SQL: ``agg`` over ``src`` is v, the row count is n."""
    return f"""SELECT '{table}' AS table_name, '{check}' AS check_name, '{column}' AS column_name, {status} AS status, '{metric}' AS metric,
      CAST(v AS DOUBLE) AS observed, CAST({threshold} AS DOUBLE) AS threshold FROM (SELECT {agg} AS v, count(*) AS n FROM {src})"""


def rows(*parts):
    return " UNION ALL ".join(parts)


def where(cond):
    return f"count(*) FILTER (WHERE {cond})"


def null_share(c):
    return f"CAST({where(c + ' IS NULL')} AS DOUBLE) / count(*)"


@query(
    "null_limits",
    rows(
        row("bronze_events", "raw_user_events", "nulls", "event_id", "null_percentage", null_share("event_id"), FAIL.format(0), "0.0"),
        row("bronze_events", "raw_user_events", "nulls", "customer_id", "null_percentage", null_share("customer_id"), WARN.format(0.05), "0.05"),
        row("bronze_events", "raw_user_events", "nulls", "product_id", "null_percentage", null_share("product_id"), WARN.format(0.2), "0.2"),
        row("bronze_events", "raw_user_events", "nulls", "device_type", "null_percentage", null_share("device_type"), WARN.format(0.2), "0.2"),
    ),
)
def _(w):
    rules = [
        Rl.null_limit("event_id", "critical_fields"), Rl.null_limit("customer_id", "important_fields"),
        Rl.null_limit("product_id"), Rl.null_limit("device_type"),
    ]
    return Rl.run_rules(w.bronze_events, "raw_user_events", rules)


COMPLETE = "CASE WHEN n = 0 THEN 'WARN' WHEN v > 0.05 THEN 'FAIL' WHEN v > 0 THEN 'WARN' ELSE 'PASS' END"


@query(
    "completeness",
    rows(*[row("bronze_sales", "raw_marketplace_sales", "completeness", c, "null_percentage", null_share(c), COMPLETE, "0.05")
           for c in ("transaction_id", "product_id", "amount", "currency")]),
)
def _(w):
    return Rl.run_rules(
        w.bronze_sales, "raw_marketplace_sales",
        [Rl.completeness(c) for c in ("transaction_id", "product_id", "amount", "currency")],
    )


@query(
    "completeness_of_day",
    rows(*[row("(SELECT * FROM bronze_events WHERE CAST(event_time AS DATE) = DATE '2024-01-15')", "raw_user_events", "completeness", c,
               "null_percentage", null_share(c), COMPLETE, "0.05") for c in ("event_id", "customer_id")]),
)
def _(w):
    from smeltry.sources.files import scan_slice

    part = scan_slice(w.bronze_events, "event_time", "2024-01-15")
    return Rl.run_rules(part, "raw_user_events", [Rl.completeness(c) for c in ("event_id", "customer_id")])


@query(
    "null_percentages",
    rows(*[row("bronze_sales", "raw_marketplace_sales", "null_percentage", c, "null_percentage", null_share(c), FAIL.format(0.05), "0.05")
           for c in ("product_id", "currency", "amount")]),
)
def _(w):
    return Rl.run_rules(w.bronze_sales, "raw_marketplace_sales", [Rl.null_count(c) for c in ("product_id", "currency", "amount")])


@query(
    "duplicate_share",
    rows(
        row("bronze_sales", "raw_marketplace_sales", "duplicates", "transaction_id_product_id", "duplicate_percentage",
            "CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT transaction_id, product_id FROM bronze_sales)) AS DOUBLE) / count(*)", FAIL.format(0.01), "0.01"),
        row("bronze_sales", "raw_marketplace_sales", "duplicates", "transaction_id", "duplicate_percentage",
            "CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT transaction_id FROM bronze_sales)) AS DOUBLE) / count(*)", FAIL.format(0.01), "0.01"),
    ),
)
def _(w):
    return Rl.run_rules(w.bronze_sales, "raw_marketplace_sales", Rl.key_duplicates(["transaction_id", "product_id"]))


@query(
    "uniqueness",
    rows(
        row("bronze_events", "raw_user_events", "uniqueness", "event_id", "duplicate_count",
            "count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_id FROM bronze_events))", FAIL.format(0), "0.0"),
        row("bronze_events", "raw_user_events", "uniqueness", "customer_id", "duplicate_count",
            "count(*) - (SELECT count(*) FROM (SELECT DISTINCT customer_id FROM bronze_events))", FAIL.format(0), "0.0"),
    ),
)
def _(w):
    return Rl.run_rules(w.bronze_events, "raw_user_events", [Rl.unique("event_id"), Rl.unique("customer_id")])


@query(
    "value_ranges",
    rows(
        row("bronze_sales", "raw_marketplace_sales", "range", "amount", "below_minimum", where("amount < 0"), FAIL.format(0), "0.0"),
        row("bronze_sales", "raw_marketplace_sales", "range", "amount", "above_maximum", where("amount > 10000"), FAIL.format(0), "10000.0"),
        row("bronze_sales", "raw_marketplace_sales", "range", "transaction_time", "below_minimum", where("transaction_time < TIMESTAMP '2024-01-01'"), FAIL.format(0)),
        row("bronze_sales", "raw_marketplace_sales", "range", "transaction_time", "above_maximum", where("transaction_time > TIMESTAMP '2024-01-20'"), FAIL.format(0)),
    ),
)
def _(w):
    rules = Rl.value_range("amount", 0, 10000) + Rl.value_range("transaction_time", "2024-01-01", "2024-01-20")
    return Rl.run_rules(w.bronze_sales, "raw_marketplace_sales", rules)


def miss(c, regex):
    return f"CAST(count({c}) FILTER (WHERE NOT regexp_matches({c}, '{regex}')) AS DOUBLE) / nullif(count({c}), 0)"


@query(
    "patterns",
    rows(
        row("dim_customer", "dim_customer_scd", "pattern", "customer_id", "violation_percentage", miss("customer_id", "^CUST-[0-9]{6}$"), FAIL.format(0.05), "0.05"),
        row("dim_customer", "dim_customer_scd", "pattern", "email", "violation_percentage", miss("email", "^[A-Za-z0-9+_.-]+@(.+)$"), FAIL.format(0.05), "0.05"),
        row("dim_customer", "dim_customer_scd", "pattern", "address", "violation_percentage", miss("address", "^Street 1"), FAIL.format(0.3), "0.3"),
    ),
)
def _(w):
    rules = [Rl.pattern("customer_id", kind="customer_id"), Rl.pattern("email", kind="email"), Rl.pattern("address", "^Street 1", limit=0.3)]
    return Rl.run_rules(w.dim_customer, "dim_customer_scd", rules)


@query(
    "business_rule_violations",
    rows(
        row("bronze_sales", "raw_marketplace_sales", "business_rule", "positive", "violation_count", where("NOT (amount > 0)"), FAIL.format(0), "0.0"),
        row("bronze_sales", "raw_marketplace_sales", "business_rule", "dollars", "violation_count", where("NOT (currency = 'USD')"), WARN.format(0), "0.0"),
        row("bronze_sales", "raw_marketplace_sales", "business_rule", "settles_later", "violation_count", where("NOT (settlement_time > transaction_time)"), WARN.format(0), "0.0"),
    ),
)
def _(w):
    rules = [
        Rl.business_rule("positive", "amount > 0", "CRITICAL"), Rl.business_rule("dollars", "currency = 'USD'"),
        Rl.business_rule("settles_later", "settlement_time > transaction_time"),
    ]
    return Rl.run_rules(w.bronze_sales, "raw_marketplace_sales", rules)


@query(
    "allowed_values",
    rows(
        row("bronze_events", "raw_user_events", "allowed_values", "device_type", "invalid_count", where("device_type NOT IN ('desktop', 'mobile')"), FAIL.format(0), "0.0"),
        row("bronze_events", "raw_user_events", "allowed_values", "product_id", "invalid_count", where("product_id NOT IN ('PROD-000001')"), FAIL.format(0), "0.0"),
    ),
)
def _(w):
    rules = [Rl.allowed_values("device_type", ["desktop", "mobile"]), Rl.allowed_values("product_id", ["PROD-000001"])]
    return Rl.run_rules(w.bronze_events, "raw_user_events", rules)


@query(
    "referential_integrity",
    rows(
        row("fact_sales", "fact_sales", "referential_integrity", "customer_sk", "orphaned_count",
            where("customer_sk IS NOT NULL AND customer_sk NOT IN (SELECT customer_sk FROM dim_customer WHERE is_current)"), FAIL.format(0), "0.0"),
        row("fact_sales", "fact_sales", "referential_integrity", "product_id", "orphaned_count",
            where("product_id NOT IN (SELECT product_id FROM dim_product WHERE is_active)"), FAIL.format(0), "0.0"),
    ),
)
def _(w):
    return Q.referential_integrity(
        w.fact_sales, "fact_sales", {"customer_sk": w.dim_customer, "product_id": w.dim_product.filter("is_active")}
    )


NEXT = "(SELECT *, lead(effective_start_date) OVER (PARTITION BY customer_id ORDER BY effective_start_date, effective_end_date, customer_sk) AS nxt FROM dim_customer)"


@query(
    "scd_integrity",
    rows(
        row("(SELECT count(*) FILTER (WHERE is_current) AS k FROM dim_customer GROUP BY customer_id)", "dim_customer_scd", "scd_integrity", "customer_id",
            "multiple_current", where("k > 1"), FAIL.format(0), "0.0"),
        row("dim_customer", "dim_customer_scd", "scd_integrity", "customer_id", "start_after_end", where("effective_start_date > effective_end_date"), FAIL.format(0), "0.0"),
        row(NEXT, "dim_customer_scd", "scd_integrity", "customer_id", "overlapping_versions", where("nxt < effective_end_date"), FAIL.format(0), "0.0"),
        row(NEXT, "dim_customer_scd", "scd_integrity", "customer_id", "gaps_between_versions", where("nxt > effective_end_date"), "'PASS'"),
    ),
)
def _(w):
    return Q.scd_integrity(w.dim_customer, "dim_customer_scd")


@query(
    "freshness",
    row("bronze_events", "raw_user_events", "freshness", "event_time", "hours_since_newest",
        "round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(event_time))) / 3600000000.0, 6)", FAIL.format(24), "24.0"),
)
def _(w):
    fresh = Q.freshness(w.bronze_events, "raw_user_events", "event_time", "2024-02-01 00:00:00", 24)
    return fresh.withColumn("observed", F.round("observed", 6))


@query(
    "volume",
    f"""SELECT {day('d', 'day')}, k AS rows, round(m, 4) AS prior_mean, CASE WHEN k < 300 OR k > 400 THEN 'FAIL' WHEN abs(k - m) > m * 0.05 THEN 'WARN' ELSE 'PASS' END AS status
    FROM (SELECT d, k, avg(k) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT CAST(event_time AS DATE) AS d, count(*) AS k FROM bronze_events GROUP BY 1))""",
)
def _(w):
    return Q.volume(w.bronze_events, "event_time", 300, 400, 0.05)


@query(
    "consistency",
    rows(
        row("(SELECT DISTINCT sale_id FROM silver_sales)", "standardized_sales", "consistency", "sale_id", "not_in_bronze",
            where("sale_id NOT IN (SELECT transaction_id FROM bronze_sales)"), FAIL.format(0), "0.0"),
        row("(SELECT DISTINCT transaction_id FROM bronze_sales)", "standardized_sales", "consistency", "sale_id", "not_in_silver",
            where("transaction_id NOT IN (SELECT sale_id FROM silver_sales)"), FAIL.format(0), "0.0"),
    ),
)
def _(w):
    return Q.consistency(w.bronze_sales, "transaction_id", w.silver_sales, "sale_id", "standardized_sales")


@query(
    "gold_business_rules",
    rows(
        row("fact_sales", "fact_sales", "business_rule", "total_is_quantity_times_price", "violation_count", where("total_amount <> quantity * unit_price"), WARN.format(0), "0.0"),
        row("fact_sales", "fact_sales", "business_rule", "positive_total", "violation_count", where("NOT (total_amount > 0)"), FAIL.format(0), "0.0"),
    ),
)
def _(w):
    rules = [
        Rl.business_rule("total_is_quantity_times_price", "total_amount = quantity * unit_price"),
        Rl.business_rule("positive_total", "total_amount > 0", "CRITICAL"),
    ]
    return Rl.run_rules(w.fact_sales, "fact_sales", rules)


# The stored metrics have a wrong sum for the website, no sum for one day of another
# channel, and no row at all for its next day.
NO_SUM, NO_ROW = "2024-01-10", "2024-01-11"


@query(
    "metrics_validation",
    f"""WITH m AS (SELECT date_id, channel, CASE WHEN date_id = DATE '{NO_SUM}' AND channel <> 'website' THEN NULL
        ELSE total_revenue + CASE WHEN channel = 'website' THEN 1 ELSE 0 END END AS total_revenue, total_revenue AS fact_revenue,
        date_id = DATE '{NO_ROW}' AND channel <> 'website' AS no_row FROM daily_sales)
    SELECT {day('date_id')}, channel, {dbl('CASE WHEN NOT no_row THEN total_revenue END', 'total_revenue')}, {dbl('fact_revenue')},
      CASE WHEN channel = 'website' OR total_revenue IS NULL OR no_row THEN 'FAIL' ELSE 'PASS' END AS status FROM m""",
)
def _(w):
    other = F.col("channel") != "website"
    metrics = gold.sales_performance(w.fact_sales, w.fact_activity)
    metrics = metrics.filter(~(other & (F.col("date_id") == F.lit(NO_ROW).cast("date")))).withColumn(
        "total_revenue",
        F.when(~(other & (F.col("date_id") == F.lit(NO_SUM).cast("date"))), F.col("total_revenue"))
        + F.when(F.col("channel") == "website", F.lit(1)).otherwise(F.lit(0)),
    )
    return Q.metrics_validation(metrics, w.fact_sales)


@query(
    "cross_layer_reconciliation",
    f"""WITH b AS (SELECT CAST(transaction_time AS DATE) AS d, count(*) FILTER (WHERE amount > 0) AS n, sum(amount) FILTER (WHERE amount > 0) AS s,
        count(*) FILTER (WHERE NOT coalesce(amount > 0, FALSE)) AS rn, sum(amount) FILTER (WHERE NOT coalesce(amount > 0, FALSE)) AS rs FROM bronze_sales GROUP BY 1),
      s AS (SELECT transaction_date AS d, count(*) AS n, sum(total_amount) AS s FROM silver_sales GROUP BY 1),
      g AS (SELECT date_id AS d, count(*) AS n, sum(total_amount) AS s FROM fact_sales GROUP BY 1)
    SELECT {day('d', 'day')}, {big('coalesce(b.n, 0)', 'bronze_rows')}, {dbl('coalesce(b.s, 0)', 'bronze_revenue')}, {big('coalesce(s.n, 0)', 'silver_rows')},
      {dbl('coalesce(s.s, 0)', 'silver_revenue')}, {big('coalesce(g.n, 0)', 'gold_rows')}, {dbl('coalesce(g.s, 0)', 'gold_revenue')},
      {big('coalesce(b.rn, 0)', 'bronze_rejected_rows')}, {dbl('coalesce(b.rs, 0)', 'bronze_rejected_revenue')},
      CASE WHEN coalesce(b.n, 0) = coalesce(s.n, 0) AND coalesce(s.n, 0) = coalesce(g.n, 0) AND coalesce(b.s, 0) = coalesce(s.s, 0) AND coalesce(s.s, 0) = coalesce(g.s, 0) THEN 'PASS' ELSE 'FAIL' END AS status
    FROM b FULL JOIN s USING (d) FULL JOIN g USING (d)""",
)
def _(w):
    return Q.cross_layer_reconciliation(
        [
            ("bronze", w.bronze_sales, "transaction_time", "amount"),
            ("silver", w.silver_sales, "transaction_time", "total_amount"),
            ("gold", gold.fact_sales(w.silver_sales, w.dim_customer), "transaction_time", "total_amount"),
        ],
        {"bronze": ~F.coalesce(F.col("amount") > 0, F.lit(False))},
    )


@query(
    "silver_post_load",
    rows(
        row("silver_sales", "standardized_sales", "post_load", "*", "row_count", "count(*)", "CASE WHEN v = 0 THEN 'WARN' ELSE 'PASS' END"),
        row("silver_sales", "standardized_sales", "post_load", "sale_id", "null_count", where("sale_id IS NULL"), WARN.format(0), "0.0"),
        row("silver_sales", "standardized_sales", "post_load", "customer_id", "null_count", where("customer_id IS NULL"), WARN.format(0), "0.0"),
        row("(SELECT sale_id, count(*) AS k FROM silver_sales GROUP BY sale_id)", "standardized_sales", "post_load", "sale_id", "duplicate_keys", where("k > 1"), WARN.format(0), "0.0"),
    ),
)
def _(w):
    return Q.silver_post_load(w.silver_sales, "standardized_sales", "sale_id", ["sale_id", "customer_id"], "transaction_time")


# --- expectations -------------------------------------------------------------

EVENT_COLUMNS = [
    "event_id", "session_id", "customer_id", "event_type", "event_time", "page_url", "product_id", "device_type",
    "time_spent_seconds", "referrer", "processed_time", "ingestion_date",
]

SUITE = X.load_suite(
    {
        "expectation_suite_name": "silver_events",
        "expectations": [
            {"expectation_type": "expect_table_columns_to_match_ordered_list", "kwargs": {"column_list": EVENT_COLUMNS}},
            {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1, "max_value": 5}},
            {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "product_id"}},
            {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "event_id"}},
            {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "product_id"}},
            {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "device_type", "value_set": ["desktop", "mobile", "tablet"]}},
            {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "event_type", "value_set": ["product_view", "add_to_cart"]}},
            {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "time_spent_seconds", "min_value": 0, "max_value": 100}},
            {"expectation_type": "expect_column_values_to_be_between",
             "kwargs": {"column": "event_time", "min_value": "2024-01-01T00:00:00", "max_value": "2025-12-31T23:59:59"}},
            {"expectation_type": "expect_column_values_to_match_regex", "kwargs": {"column": "customer_id", "regex": "^CUST-\\d{6}$"}},
            {"expectation_type": "expect_column_values_to_match_regex", "kwargs": {"column": "product_id", "regex": "^PROD-00000"}},
            {"expectation_type": "expect_column_pair_values_to_be_equal",
             "kwargs": {"column_A": "event_time", "column_B": "processed_time", "ignore_row_if": "either_value_is_missing"}},
            {"expectation_type": "expect_column_pair_values_A_to_be_greater_than_or_equal_to_B",
             "kwargs": {"column_A": "processed_time", "column_B": "event_time"}},
            {"expectation_type": "expect_column_pair_values_A_to_be_greater_than_B",
             "kwargs": {"column_A": "processed_time", "column_B": "event_time"}},
            {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "platform"}},
        ],
    }
)

SUITE_SQL = f"""SELECT 'silver_events' AS suite, CAST(i AS BIGINT) AS position, kind AS expectation_type, col AS column_name, ok AS success, CAST(u AS BIGINT) AS unexpected_count FROM (
  SELECT 0 AS i, 'expect_table_columns_to_match_ordered_list' AS kind, NULL AS col, TRUE AS ok, NULL AS u
  UNION ALL SELECT 1, 'expect_table_row_count_to_be_between', NULL, count(*) BETWEEN 1 AND 5, NULL FROM silver_events
  UNION ALL SELECT 14, 'expect_column_values_to_not_be_null', 'platform', FALSE, NULL
  UNION ALL SELECT i, kind, col, u = 0, u FROM (
    SELECT 2 AS i, 'expect_column_values_to_not_be_null' AS kind, 'product_id' AS col, {where('product_id IS NULL')} AS u FROM silver_events
    UNION ALL SELECT 3, 'expect_column_values_to_be_unique', 'event_id', count(event_id) - count(DISTINCT event_id) FROM silver_events
    UNION ALL SELECT 4, 'expect_column_values_to_be_unique', 'product_id', count(product_id) - count(DISTINCT product_id) FROM silver_events
    UNION ALL SELECT 5, 'expect_column_values_to_be_in_set', 'device_type', {where("device_type NOT IN ('desktop', 'mobile', 'tablet')")} FROM silver_events
    UNION ALL SELECT 6, 'expect_column_values_to_be_in_set', 'event_type', {where("event_type NOT IN ('product_view', 'add_to_cart')")} FROM silver_events
    UNION ALL SELECT 7, 'expect_column_values_to_be_between', 'time_spent_seconds', {where('time_spent_seconds < 0 OR time_spent_seconds > 100')} FROM silver_events
    UNION ALL SELECT 8, 'expect_column_values_to_be_between', 'event_time', {where("event_time < TIMESTAMP '2024-01-01' OR event_time > TIMESTAMP '2025-12-31 23:59:59'")} FROM silver_events
    UNION ALL SELECT 9, 'expect_column_values_to_match_regex', 'customer_id', {where("NOT regexp_matches(customer_id, '^CUST-[0-9]{6}$')")} FROM silver_events
    UNION ALL SELECT 10, 'expect_column_values_to_match_regex', 'product_id', {where("NOT regexp_matches(product_id, '^PROD-00000')")} FROM silver_events
    UNION ALL SELECT 11, 'expect_column_pair_values_to_be_equal', 'event_time,processed_time', {where("event_time <> TIMESTAMP '2024-02-01'")} FROM silver_events
    UNION ALL SELECT 12, 'expect_column_pair_values_A_to_be_greater_than_or_equal_to_B', 'processed_time,event_time', {where("TIMESTAMP '2024-02-01' < event_time")} FROM silver_events
    UNION ALL SELECT 13, 'expect_column_pair_values_A_to_be_greater_than_B', 'processed_time,event_time', {where("TIMESTAMP '2024-02-01' <= event_time")} FROM silver_events))"""


@query("expectation_suite", SUITE_SQL)
def _(w):
    return X.run_suite(w.silver_events, SUITE)


EASY = X.load_suite(
    {
        "expectation_suite_name": "silver_sales",
        "expectations": [
            {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "sale_id"}},
            {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "sale_id"}},
            {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "quantity", "min_value": 1, "max_value": 49}},
            {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "total_amount", "min_value": 0.01}},
            {"expectation_type": "expect_column_values_to_match_regex", "kwargs": {"column": "sale_id", "regex": "^TXN-"}},
        ],
    }
)


def _checkpoint(w):
    return X.run_checkpoint(
        [
            ("standardized_user_events", w.silver_events, SUITE, None),
            ("standardized_sales", w.silver_sales, EASY, None),
        ]
    )


TABLE_SQL = f"""SELECT 'standardized_user_events' AS table_name, count(*) AS total, count(*) FILTER (WHERE success) AS passed FROM ({SUITE_SQL})
  UNION ALL SELECT 'standardized_sales', 5, (SELECT CAST(count(*) = 0 AS INTEGER) FROM silver_sales WHERE sale_id IS NULL)
    + (SELECT CAST(count(*) = count(DISTINCT sale_id) AS INTEGER) FROM silver_sales) + (SELECT CAST(count(*) = 0 AS INTEGER) FROM silver_sales WHERE NOT (quantity BETWEEN 1 AND 49))
    + (SELECT CAST(count(*) = 0 AS INTEGER) FROM silver_sales WHERE total_amount < 0.01) + (SELECT CAST(count(*) = 0 AS INTEGER) FROM silver_sales WHERE NOT sale_id LIKE 'TXN-%')"""
STATUS_SQL = f"""SELECT table_name, CAST(total AS BIGINT) AS total, CAST(passed AS BIGINT) AS passed, CAST(total - passed AS BIGINT) AS failed,
  round(passed * 100.0 / total, 4) AS success_percent,
  CASE WHEN passed = total THEN 'PASSED' WHEN passed * 100.0 / total >= 80 THEN 'WARNING' ELSE 'FAILED' END AS status FROM ({TABLE_SQL})"""


@query("expectation_rollup", f"SELECT * FROM ({STATUS_SQL})")
def _(w):
    return U.expectation_status(_checkpoint(w))


def _rules(w):
    events = Rl.run_rules(w.silver_events, "standardized_user_events", [Rl.completeness("event_id"), Rl.unique("event_id")])
    sales = Rl.run_rules(
        w.silver_sales, "standardized_sales",
        [Rl.completeness("sale_id"), Rl.business_rule("dollars", "currency = 'USD'")],
    )
    return events.unionByName(sales)


RULES_SQL = rows(
    row("silver_events", "standardized_user_events", "completeness", "event_id", "null_percentage", null_share("event_id"), COMPLETE, "0.05"),
    row("silver_events", "standardized_user_events", "uniqueness", "event_id", "duplicate_count", "count(*) - count(DISTINCT event_id)", FAIL.format(0), "0.0"),
    row("silver_sales", "standardized_sales", "completeness", "sale_id", "null_percentage", null_share("sale_id"), COMPLETE, "0.05"),
    row("silver_sales", "standardized_sales", "business_rule", "dollars", "violation_count", where("NOT (currency = 'USD')"), WARN.format(0), "0.0"),
)
WORST = "CASE max(CASE status WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 1 WHEN 'FAIL' THEN 2 ELSE 3 END) WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' WHEN 2 THEN 'FAIL' ELSE 'ERROR' END"


@query(
    "status_rollup",
    f"""SELECT table_name, {WORST} AS status, count(*) AS checks, count(*) FILTER (WHERE status = 'PASS') AS passed,
      count(*) FILTER (WHERE status = 'WARN') AS warnings, count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) AS failed FROM ({RULES_SQL}) GROUP BY table_name""",
)
def _(w):
    return U.status_by(_rules(w), "table_name")


@query(
    "layer_status",
    f"""SELECT 'silver' AS layer, {WORST} AS status, count(DISTINCT table_name) AS tables, count(*) AS checks, count(*) FILTER (WHERE status = 'PASS') AS passed,
      count(*) FILTER (WHERE status = 'WARN') AS warnings, count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) AS failed FROM ({RULES_SQL})""",
)
def _(w):
    return U.layer_status(_rules(w), "silver")


HYBRID_SQL = f"""SELECT table_name, CAST(sum(total) AS BIGINT) AS total, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(total) - sum(passed) AS BIGINT) AS failed,
  round(CAST(sum(passed) AS DOUBLE) * 100 / sum(total), 4) AS success_percent,
  CASE max(level) WHEN 0 THEN 'PASSED' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'FAILED' ELSE 'ERROR' END AS status FROM (
    SELECT table_name, count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed,
      max(CASE status WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 1 WHEN 'FAIL' THEN 2 ELSE 3 END) AS level FROM ({RULES_SQL}) GROUP BY table_name
    UNION ALL SELECT table_name, total, passed, CASE status WHEN 'PASSED' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END FROM ({STATUS_SQL})) GROUP BY table_name"""


def _hybrid(w):
    return U.hybrid_status(_rules(w), _checkpoint(w))


@query("hybrid_rollup", HYBRID_SQL)
def _(w):
    return _hybrid(w)


LAYER_SQL = """SELECT count(*) AS tables, count(*) FILTER (WHERE status = 'PASSED') AS tables_passed, count(*) FILTER (WHERE status = 'WARNING') AS tables_warning,
  count(*) FILTER (WHERE status IN ('FAILED', 'ERROR')) AS tables_failed, CAST(sum(total) AS BIGINT) AS total, CAST(sum(passed) AS BIGINT) AS passed,
  CAST(sum(failed) AS BIGINT) AS failed, round(CAST(sum(passed) AS DOUBLE) * 100 / sum(total), 4) AS success_percent,
  CASE WHEN count(*) FILTER (WHERE status IN ('FAILED', 'ERROR')) > 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE status = 'WARNING') > 0 THEN 'WARNING' ELSE 'PASSED' END AS status"""


@query("hybrid_layer", f"{LAYER_SQL} FROM ({HYBRID_SQL})")
def _(w):
    return U.hybrid_layer_status(_hybrid(w))


@query(
    "layer_alerts",
    f"""WITH l AS ({LAYER_SQL} FROM ({HYBRID_SQL})) SELECT 'silver' AS layer, 'CRITICAL' AS severity, tables_failed, success_percent FROM l WHERE status = 'FAILED'
    UNION ALL SELECT 'silver', 'WARNING', tables_failed, success_percent FROM l WHERE success_percent < 85""",
)
def _(w):
    return U.alerts(U.hybrid_layer_status(_hybrid(w)), "silver")


@query(
    "run_summary",
    f"""WITH l AS ({LAYER_SQL}, layer FROM (SELECT *, CASE table_name WHEN 'standardized_sales' THEN 'gold' ELSE 'silver' END AS layer FROM ({STATUS_SQL})) GROUP BY layer)
    SELECT count(*) AS layers, count(*) FILTER (WHERE status <> 'FAILED') AS layers_passed, count(*) FILTER (WHERE status = 'FAILED') AS layers_failed,
      CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(tables_passed) AS BIGINT) AS tables_passed, CAST(sum(tables_failed) AS BIGINT) AS tables_failed,
      CAST(sum(total) AS BIGINT) AS expectations, CAST(sum(passed) AS BIGINT) AS expectations_passed, CAST(sum(failed) AS BIGINT) AS expectations_failed,
      CASE WHEN count(*) FILTER (WHERE status = 'FAILED') = 0 THEN 'PASSED'
        WHEN count(*) FILTER (WHERE status <> 'FAILED') > count(*) FILTER (WHERE status = 'FAILED') THEN 'WARNING' ELSE 'FAILED' END AS status FROM l""",
)
def _(w):
    tables = U.expectation_status(_checkpoint(w)).withColumn(
        "layer", F.when(F.col("table_name") == "standardized_sales", "gold").otherwise("silver")
    )
    return U.run_summary(U.expectation_layer_status(tables))


def schema_rows(table, *columns):
    return rows(*[
        f"SELECT '{table}' AS table_name, 'schema' AS check_name, '{c}' AS column_name, 'PASS' AS status, 'present' AS metric, CAST(1 AS DOUBLE) AS observed, CAST(1 AS DOUBLE) AS threshold"
        for c in columns
    ])


def unique_row(src, table, c):
    return row(src, table, "uniqueness", c, "duplicate_count", f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {c} FROM {src}))", FAIL.format(0), "0.0")


def complete_rows(src, table, *columns):
    return rows(*[row(src, table, "completeness", c, "null_percentage", null_share(c), COMPLETE, "0.05") for c in columns])


BRONZE_EVENTS_SQL = rows(
    schema_rows("raw_user_events", "event_id", "customer_id", "event_type", "event_time"),
    complete_rows("bronze_events", "raw_user_events", "event_id", "event_type", "event_time"),
    unique_row("bronze_events", "raw_user_events", "event_id"),
    row("bronze_events", "raw_user_events", "range", "event_time", "below_minimum", where("event_time < TIMESTAMP '2024-01-01'"), FAIL.format(0)),
    row("bronze_events", "raw_user_events", "range", "event_time", "above_maximum", where("event_time > TIMESTAMP '2025-12-31'"), FAIL.format(0)),
    row("bronze_events", "raw_user_events", "allowed_values", "event_type", "invalid_count", where("event_type = 'error'"), FAIL.format(0), "0.0"),
)
BRONZE_SALES_SQL = rows(
    schema_rows("raw_marketplace_sales", "transaction_id", "product_id", "amount", "transaction_time"),
    complete_rows("bronze_sales", "raw_marketplace_sales", "transaction_id", "product_id", "amount"),
    unique_row("bronze_sales", "raw_marketplace_sales", "transaction_id"),
    row("bronze_sales", "raw_marketplace_sales", "range", "amount", "below_minimum", where("amount < 0"), FAIL.format(0), "0.0"),
    row("bronze_sales", "raw_marketplace_sales", "range", "amount", "above_maximum", where("amount > 10000"), FAIL.format(0), "10000.0"),
)


@query("validate_table", BRONZE_EVENTS_SQL)
def _(w):
    return Q.validate_table(w.bronze_events, "raw_user_events", Q.LAYER_RULES["bronze"]["raw_user_events"])


@query("validate_from_counters", BRONZE_EVENTS_SQL)
def _(w):
    # days counted by an earlier run, and those that came since
    config, day = Q.LAYER_RULES["bronze"]["raw_user_events"], F.to_date("event_time")
    rules = Rl.rules_from_config(config, w.bronze_events.columns)
    old = w.bronze_events.filter(~F.coalesce(day >= F.lit("2024-01-20"), F.lit(False)))
    new = w.bronze_events.filter(day >= F.lit("2024-01-20"))
    counters = K.rule_counters(old, "raw_user_events", rules, day).unionByName(K.rule_counters(new, "raw_user_events", rules, day))
    return K.validate_from_counters(counters, w.bronze_events, "raw_user_events", config)


@query("validate_bronze_layer", rows(BRONZE_EVENTS_SQL, BRONZE_SALES_SQL))
def _(w):
    return Q.validate_layer(
        {"raw_user_events": w.bronze_events, "raw_marketplace_sales": w.bronze_sales}, Q.LAYER_RULES["bronze"]
    )


@query(
    "validate_gold_layer",
    rows(
        schema_rows("fact_sales", "sale_id", "product_id", "customer_sk", "total_amount"),
        complete_rows("fact_sales", "fact_sales", "sale_id", "product_id", "total_amount"),
        unique_row("fact_sales", "fact_sales", "sale_id"),
        row("fact_sales", "fact_sales", "referential_integrity", "customer_sk", "orphaned_count",
            where("customer_sk IS NOT NULL AND customer_sk NOT IN (SELECT customer_sk FROM dim_customer WHERE is_current)"), FAIL.format(0), "0.0"),
        row("fact_sales", "fact_sales", "referential_integrity", "product_id", "orphaned_count",
            where("product_id NOT IN (SELECT product_id FROM dim_product)"), FAIL.format(0), "0.0"),
    ),
)
def _(w):
    return Q.validate_layer(
        {"fact_sales": w.fact_sales}, Q.LAYER_RULES["gold"],
        {"dim_customer_scd": w.dim_customer, "dim_product": w.dim_product},
    )


SILVER_EVENTS_SQL = rows(
    schema_rows("standardized_user_events", "event_id", "customer_id", "event_type", "event_time"),
    complete_rows("silver_events", "standardized_user_events", "event_id", "event_type", "event_time"),
    unique_row("silver_events", "standardized_user_events", "event_id"),
    row("silver_events", "standardized_user_events", "referential_integrity", "customer_id", "orphaned_count",
        where("customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM dim_customer WHERE is_current)"), FAIL.format(0), "0.0"),
)
SILVER_SALES_SQL = rows(
    schema_rows("standardized_sales", "sale_id", "product_id", "total_amount", "transaction_time"),
    complete_rows("silver_sales", "standardized_sales", "sale_id", "product_id", "total_amount"),
    unique_row("silver_sales", "standardized_sales", "sale_id"),
    row("silver_sales", "standardized_sales", "range", "total_amount", "below_minimum", where("total_amount < 0"), FAIL.format(0), "0.0"),
    row("silver_sales", "standardized_sales", "range", "total_amount", "above_maximum", where("total_amount > 50000"), FAIL.format(0), "50000.0"),
)


@query("validate_silver_layer", rows(SILVER_EVENTS_SQL, SILVER_SALES_SQL))
def _(w):
    return Q.validate_layer(
        {"standardized_user_events": w.silver_events, "standardized_sales": w.silver_sales}, Q.LAYER_RULES["silver"],
        {"dim_customer_scd": w.dim_customer},
    )


DAY = "2024-01-15"
OF_DAY = f"(SELECT * FROM bronze_events WHERE CAST(event_time AS DATE) = DATE '{DAY}')"


@query(
    "validate_table_of_day",
    rows(
        schema_rows("raw_user_events", "event_id", "customer_id", "event_type", "event_time"),
        complete_rows(OF_DAY, "raw_user_events", "event_id", "event_type", "event_time"),
        unique_row(OF_DAY, "raw_user_events", "event_id"),
        row(OF_DAY, "raw_user_events", "range", "event_time", "below_minimum", where("event_time < TIMESTAMP '2024-01-01'"), FAIL.format(0)),
        row(OF_DAY, "raw_user_events", "range", "event_time", "above_maximum", where("event_time > TIMESTAMP '2025-12-31'"), FAIL.format(0)),
        row(OF_DAY, "raw_user_events", "allowed_values", "event_type", "invalid_count", where("event_type = 'error'"), FAIL.format(0), "0.0"),
    ),
)
def _(w):
    return Q.validate_table(
        w.bronze_events, "raw_user_events", Q.LAYER_RULES["bronze"]["raw_user_events"], slice_of=Q.day_slice("event_time", DAY)
    )


@query(
    "validate_feature_table",
    rows(
        schema_rows("customer_product_interactions", "customer_id", "product_id", "feature_date"),
        complete_rows(f"({FEATURE_TABLE_SQL})", "customer_product_interactions", "customer_id", "product_id", "feature_date"),
        row(f"({FEATURE_TABLE_SQL})", "customer_product_interactions", "range", "view_count_7d", "below_minimum", where("view_count_7d < 0"), FAIL.format(0), "0.0"),
        row(f"({FEATURE_TABLE_SQL})", "customer_product_interactions", "range", "view_count_7d", "above_maximum", where("view_count_7d > 1000"), FAIL.format(0), "1000.0"),
        row(f"({FEATURE_TABLE_SQL})", "customer_product_interactions", "range", "category_affinity_score", "below_minimum", where("category_affinity_score < 0"), FAIL.format(0), "0.0"),
        row(f"({FEATURE_TABLE_SQL})", "customer_product_interactions", "range", "category_affinity_score", "above_maximum", where("category_affinity_score > 1"), FAIL.format(0), "1.0"),
    ),
)
def _(w):
    return Q.validate_layer({"customer_product_interactions": feature_table(w)}, Q.LAYER_RULES["gold"])
