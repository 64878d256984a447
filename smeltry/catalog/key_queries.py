"""Deduplication, latest version, ranking, set operations."""

from pyspark.sql import functions as F

from smeltry.catalog.registry import query
from smeltry.catalog.tables import big, day, dbl, each, ts
from smeltry.operators import aggregates as A
from smeltry.operators import joins as J
from smeltry.operators import keys as K
from smeltry.operators import upsert as U
from smeltry.plans import dims, features, gold, late

CAMPAIGN_SQL = f"SELECT campaign_id, campaign_name, campaign_type, {each(day, 'start_date', 'end_date')}, {dbl('budget')}, target_audience"


@query("latest_campaigns", f"{CAMPAIGN_SQL}, {ts('ingestion_time')} FROM dim_campaign")
def _(w):
    return dims.latest_campaigns(w.campaign_history)


@query(
    "price_rank_in_category",
    f"""SELECT product_id, category, {dbl('base_price')},
      row_number() OVER (PARTITION BY category ORDER BY base_price DESC, product_id) AS product_price_rank_in_category FROM dim_product""",
)
def _(w):
    return features.price_rank_in_category(w.dim_product)


@query(
    "latest_by_business_key",
    f"""SELECT marketplace_name, seller_id, product_id, {ts('transaction_time')}, transaction_id, {dbl('amount')},
      {big('quantity')}, {ts('ingestion_time')} FROM bronze_sales
    QUALIFY row_number() OVER (PARTITION BY marketplace_name, seller_id, product_id, transaction_time
      ORDER BY ingestion_time DESC, transaction_id, amount NULLS LAST, quantity NULLS LAST) = 1""",
)
def _(w):
    return late.keep_latest_by_business_key(w.bronze_sales).select(
        "marketplace_name", "seller_id", "product_id", "transaction_time", "transaction_id", "amount",
        "quantity", "ingestion_time",
    )


@query(
    "dedupe_by_key",
    f"""SELECT l_orderkey, {big('l_linenumber')}, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) = 1""",
)
def _(w):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    return K.dedupe(w.table("lineitem").select(*cols), ["l_orderkey", "l_linenumber"])


@query(
    "distinct_snapshots",
    f"""SELECT DISTINCT customer_id, customer_name, email, address, city, country, membership_tier,
      {ts('last_updated')} FROM customer_snapshot""",
)
def _(w):
    return w.customer_snapshot.distinct()


@query(
    "insert_update_split",
    """SELECT customer_id, CASE WHEN customer_id IN (SELECT customer_id FROM dim_customer_v0) THEN 'update' ELSE 'insert' END AS action
    FROM (SELECT DISTINCT customer_id FROM customer_snapshot)""",
)
def _(w):
    key = ["customer_id"]
    new = J.new_keys(w.customer_snapshot, w.dim_customer_v0, key).withColumn("action", F.lit("insert"))
    old = J.known_keys(w.customer_snapshot, w.dim_customer_v0, key).withColumn("action", F.lit("update"))
    return new.unionByName(old)


@query(
    "union_of_aggregates",
    f"""SELECT 'sales' AS source, channel, {big('count(*)', 'days')}, {big('sum(total_transactions)', 'n')} FROM daily_sales GROUP BY channel
    UNION ALL SELECT 'visits', channel, {big('count(*)', 'days')}, {big('sum(total_visitors)', 'n')} FROM channel_visitors GROUP BY channel""",
)
def _(w):
    def by_channel(df, source, n):
        return df.groupBy("channel").agg(F.count(F.lit(1)).alias("days"), F.sum(n).alias("n")).withColumn("source", F.lit(source))

    return by_channel(gold.daily_channel_sales(w.fact_sales), "sales", "total_transactions").unionByName(
        by_channel(gold.channel_visitors(w.fact_activity), "visits", "total_visitors")
    )


@query(
    "union_history",
    f"""SELECT campaign_id, {ts('ingestion_time')}, {dbl('budget')} FROM campaign_history
    UNION ALL SELECT campaign_id, {ts("ingestion_time + to_days(30)", 'ingestion_time')}, {dbl("budget * 2", 'budget')} FROM campaign_history
      WHERE target_audience = 'loyal'""",
)
def _(w):
    cols = ["campaign_id", "ingestion_time", "budget"]
    again = w.campaign_history.filter("target_audience = 'loyal'").select(
        "campaign_id", (F.col("ingestion_time") + F.expr("make_dt_interval(30)")).alias("ingestion_time"),
        (F.col("budget") * 2).cast("decimal(15,2)").alias("budget"),
    )
    return U.union_history([w.campaign_history.select(*cols), again])


@query(
    "duplicate_groups",
    f"""SELECT transaction_id, count(*) AS duplicate_count, {ts('max(ingestion_time)', 'latest_ingestion')},
      {ts('min(ingestion_time)', 'earliest_ingestion')} FROM bronze_sales GROUP BY transaction_id HAVING count(*) > 1""",
)
def _(w):
    return K.duplicate_groups(w.bronze_sales, ["transaction_id"], "ingestion_time")


@query(
    "duplicate_members",
    f"""SELECT transaction_id, product_id, duplicate_count, {ts('latest_ingestion')}, {ts('earliest_ingestion')} FROM (
      SELECT transaction_id, product_id, count(*) OVER p AS duplicate_count, max(ingestion_time) OVER p AS latest_ingestion,
        min(ingestion_time) OVER p AS earliest_ingestion FROM bronze_sales WINDOW p AS (PARTITION BY transaction_id))
    WHERE duplicate_count > 1""",
)
def _(w):
    return K.duplicate_members(w.bronze_sales, ["transaction_id"], "product_id", "ingestion_time")


@query(
    "duplicate_key_count",
    "SELECT count(*) AS duplicate_count FROM (SELECT transaction_id FROM bronze_sales GROUP BY transaction_id HAVING count(*) > 1)",
)
def _(w):
    return K.duplicate_key_count(w.bronze_sales, ["transaction_id"])


@query(
    "spread_index",
    """SELECT customer_id, 1000 + 1 + slot + 4096 * (row_number() OVER (PARTITION BY slot ORDER BY digest, customer_id) - 1) AS customer_sk
    FROM (SELECT customer_id, md5(customer_id) AS digest, CAST('0x' || substr(md5(customer_id), 1, 3) AS BIGINT) AS slot FROM customers)""",
)
def _(w):
    return K.spread_index(w.customers.select("customer_id"), "customer_id", "customer_sk", start=1000)


@query(
    "ordered_delays",
    """SELECT marketplace_name, count(*) AS late_count, avg(h) AS avg_delay, max(h) AS max_delay FROM (
      SELECT marketplace_name, round((epoch(ingestion_time) - epoch(transaction_time)) / 3600.0, 2) AS h FROM bronze_sales
      WHERE CAST(transaction_time AS DATE) <> CAST(ingestion_time AS DATE)) GROUP BY marketplace_name ORDER BY late_count DESC, marketplace_name""",
)
def _(w):
    return late.marketplace_stats(late.with_arrival_delay(w.bronze_sales).filter("is_late_arrival"))


@query(
    "distinct_sample",
    "SELECT DISTINCT seller_id FROM bronze_sales ORDER BY seller_id LIMIT 5",
)
def _(w):
    return K.distinct_sample(w.bronze_sales, ["seller_id"], 5)


@query(
    "version_counts",
    "SELECT campaign_id, count(*) AS versions FROM campaign_history GROUP BY campaign_id",
)
def _(w):
    return A.version_counts(w.campaign_history, "campaign_id")
