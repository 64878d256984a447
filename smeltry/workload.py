"""The given benchmark tables seen as a retail business.

Every frame is derived by Spark from whole input tables, so the work grows with
them. ``smeltry.catalog.tables`` states the same derivations in ANSI SQL.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smeltry.operators.history import CUSTOMER_ATTRIBUTES, scd2_apply
from smeltry.plans import dims, gold, silver

STAMP = "2024-02-01 00:00:00"
SNAPSHOT_DAY = "2024-01-16"
PRODUCT_DAY = "2024-01-15"
FEATURE_DAY = "2024-01-15"
SEGMENT_DAY = "2024-02-20"

CHANNEL_MAP = [
    ("CAMP-Brand#1", "website", "website", "High Value"),
    ("CAMP-Brand#2", "mobile_app", "mobile_app", "Medium Value"),
    ("CAMP-Brand#2", "marketplace", "mobile_app", "Medium Value"),
    ("CAMP-Brand#3", "marketplace", "marketplace", "Low Value"),
    ("CAMP-Brand#4", "in_store", "in_store", "Low Value"),
]


def _id(prefix: str, number: str) -> Column:
    """Zero-padded id that grows beyond six digits instead of being cut."""
    text = F.col(number).cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0")))


def _money(value: Column, digits: str = "decimal(10,2)") -> Column:
    return value.cast(digits)


def plain(df: DataFrame) -> DataFrame:
    """Output types that read the same from any engine: bigint, double, text, boolean."""
    out = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if dtype.startswith("decimal") or dtype == "float":
            c = c.cast("double")
        elif dtype in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif dtype == "date":
            c = c.cast("string")
        elif dtype.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(c.alias(name))
    return df.select(*out)


class Workload:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- bronze ---------------------------------------------------------------

    @cached_property
    def bronze_sales(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        li = self.table("lineitem").drop("l_shipdate")
        j = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
        # Cents as an integer: cheaper than a cast from double.
        cents = F.floor(F.col("l_extendedprice") / 10).cast("decimal(12,0)")
        amount = _money(cents * F.lit(Decimal("0.01")))
        p, q, line = F.col("o_orderpriority"), F.col("l_quantity"), F.col("l_linenumber")
        at = F.expr(
            "timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(o_orderkey % 30 as int), l_linenumber)"
        )
        return j.select(
            F.concat(F.lit("TXN-"), F.col("l_orderkey").cast("string"), F.lit("-"), line.cast("string")).alias("transaction_id"),
            F.when(p == "1-URGENT", "Amazon").when(p == "2-HIGH", "eBay").when(p == "3-MEDIUM", "Shopify")
            .when(p == "4-NOT SPECIFIED", "Etsy").otherwise("Walmart").alias("marketplace_name"),
            _id("SELLER-", "l_suppkey").alias("seller_id"),
            F.when(~((q == 49) & (line == 7)), _id("PROD-", "l_partkey")).alias("product_id"),
            F.when((F.col("l_returnflag") == "R") & (q == 50), -amount).otherwise(amount).cast("decimal(10,2)").alias("amount"),
            F.when((line == 6) & (q == 48), F.lit(None))
            .when(F.col("o_orderstatus") == "O", "USD").when(F.col("o_orderstatus") == "F", "EUR")
            .when(F.col("l_linestatus") == "O", "GBP").otherwise("JPY").alias("currency"),
            q.cast("int").alias("quantity"),
            at.alias("transaction_time"),
            (at + F.expr("make_dt_interval(0, 6 * l_linenumber)")).alias("settlement_time"),
            F.when(F.col("l_returnflag") == "A", "credit_card").when(F.col("l_returnflag") == "N", "paypal")
            .otherwise("bank_transfer").alias("payment_method"),
            F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"),
            F.create_map(
                F.lit("commission_rate"), _money(F.col("l_discount"), "decimal(5,3)").cast("string"),
                F.lit("shipping_cost"), _money(q, "decimal(8,2)").cast("string"),
                F.lit("tax_amount"), _money(F.col("l_tax"), "decimal(8,2)").cast("string"),
            ).alias("marketplace_metadata"),
            (at + F.expr("make_dt_interval(0, cast(l_quantity as int))")).alias("ingestion_time"),
            _id("CUST-", "o_custkey").alias("buyer_id"),
        )

    @property
    def channel(self) -> Column:
        m = F.col("marketplace_name")
        return F.when(m == "Amazon", "website").when(m == "eBay", "mobile_app").otherwise("marketplace")

    @cached_property
    def _events(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("at"), "user_id",
            F.col("event_type").alias("kind"), "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def bronze_events(self) -> DataFrame:
        return self._bronze_events().drop("n", "value", "kind")

    def _bronze_events(self) -> DataFrame:
        kind, k = F.col("kind"), F.col("k")
        shopping = kind.isin("view", "click", "purchase")
        metadata = F.create_map(
            F.lit("product_id"), F.when(shopping, _id("PROD-", "k")),
            F.lit("time_spent_seconds"),
            F.when(kind.isin("view", "click"), _money(F.col("value")).cast("string")),
            F.lit("referrer"), F.when(k >= 50, F.lit("search")),
            F.lit("category"), F.when(kind == "purchase", F.concat(F.lit("cat_"), (k % 6).cast("string"))),
        )
        return self._events.select(
            "n", "value", "kind",
            F.concat(F.lit("EVT-"), F.col("n").cast("string")).alias("event_id"),
            F.concat(F.lit("sess_"), F.col("user_id").cast("string"), F.lit("_"), F.date_format("at", "yyyyMMdd")).alias("session_id"),
            F.when(~((kind == "error") & (k >= 95)), _id("CUST-", "user_id")).alias("customer_id"),
            F.when(kind == "view", "product_view").when(kind == "click", "add_to_cart")
            .when(kind == "purchase", "purchase_complete").when(kind == "signup", "user_login")
            .otherwise(kind).alias("event_type"),
            F.col("at").alias("event_time"),
            F.concat(F.when(F.col("n") % 2 == 0, "/app/product/").otherwise("/product/"), k.cast("string")).alias("page_url"),
            F.when(shopping, _id("PROD-", "k")).alias("product_id"),
            F.when(F.col("user_id") % 3 == 0, "desktop").when(F.col("user_id") % 3 == 1, "mobile").otherwise("tablet").alias("device_type"),
            F.map_filter(metadata, lambda _, v: v.isNotNull()).alias("metadata"),
            (F.col("at") + F.expr("make_dt_interval(0, k)")).alias("ingestion_time"),
        )

    @cached_property
    def event_envelope(self) -> DataFrame:
        e = self._bronze_events()
        iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        body = F.to_json(
            F.struct(
                "event_id", "session_id", "customer_id", "event_type",
                F.date_format("event_time", iso).alias("event_time"), "page_url", "device_type",
                "metadata", F.date_format("ingestion_time", iso).alias("ingestion_time"),
            )
        )
        broken = (F.col("kind") == "error") & (F.col("value") < 1)
        return e.select(
            F.col("customer_id").alias("key"),
            F.when(broken, F.lit("{not json")).otherwise(body).alias("value"),
            F.lit("user_activity_events").alias("topic"),
            (F.col("n") % 6).cast("int").alias("partition"),
            F.floor(F.col("n") / 6).cast("bigint").alias("offset"),
            F.col("ingestion_time").alias("timestamp"),
        )

    @cached_property
    def sales_envelope(self) -> DataFrame:
        iso = "yyyy-MM-dd'T'HH:mm:ss"
        body = F.to_json(
            F.struct(
                "transaction_id", "marketplace_name", "seller_id", "product_id", "amount", "currency",
                "quantity", F.date_format("transaction_time", iso).alias("transaction_time"),
                F.date_format("settlement_time", iso).alias("settlement_time"), "payment_method",
                "status", "marketplace_metadata",
                F.date_format("ingestion_time", iso).alias("ingestion_time"),
            )
        )
        return self.bronze_sales.select(
            F.col("transaction_id").alias("key"), body.alias("value"),
            F.lit("marketplace_sales").alias("topic"), (F.col("quantity") % 3).alias("partition"),
            F.floor(F.col("amount") * 100).cast("bigint").alias("offset"),
            F.col("ingestion_time").alias("timestamp"),
        )

    @cached_property
    def bronze_products(self) -> DataFrame:
        p = self.table("part")
        price = _money(F.col("p_retailprice"))

        def version(rows, cost, active, updated):
            return rows.select(
                _id("PROD-", "p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
                F.col("p_type").alias("category"), F.split("p_name", " ")[0].alias("subcategory"),
                F.col("p_brand").alias("brand"), cost.cast("decimal(10,2)").alias("base_price"),
                F.lit(None).cast("string").alias("description"), active.alias("is_active"),
                updated.alias("last_updated"), updated.alias("ingestion_time"),
            )

        first = version(p, price, F.lit(True), F.lit("2023-11-01 00:00:00").cast("timestamp"))
        later = version(
            p.filter("p_size > 25"), price + F.lit(1).cast("decimal(10,2)"), F.col("p_size") < 45,
            F.expr("timestamp'2023-12-01 00:00:00' + make_dt_interval(p_size)"),
        )
        return first.unionByName(later)

    @cached_property
    def campaign_history(self) -> DataFrame:
        start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
        return self.table("part").select(
            F.concat(F.lit("CAMP-"), "p_brand").alias("campaign_id"),
            F.col("p_name").alias("campaign_name"), F.col("p_type").alias("campaign_type"),
            start.alias("start_date"), F.date_add(start, 30).alias("end_date"),
            _money(F.col("p_retailprice"), "decimal(15,2)").alias("budget"),
            F.when(F.col("p_size") <= 20, "new").otherwise("loyal").alias("target_audience"),
            F.expr("timestamp'2023-12-01 00:00:00' + make_dt_interval(0, 0, 0, p_partkey)").alias("ingestion_time"),
        )

    @cached_property
    def channel_map(self) -> DataFrame:
        return self.spark.createDataFrame(
            CHANNEL_MAP, "campaign_id string, sales_channel string, channel string, customer_segment string"
        )

    # --- customers ------------------------------------------------------------

    @cached_property
    def customers(self) -> DataFrame:
        """Customers with geography, as first loaded (no email below zero balance)."""
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        seg = F.col("c_mktsegment")
        return (
            c.join(n, c.c_nationkey == n.n_nationkey, "inner").join(r, n.n_regionkey == r.r_regionkey, "inner")
            .select(
                "c_custkey", "c_acctbal", _id("CUST-", "c_custkey").alias("customer_id"),
                F.col("c_name").alias("customer_name"),
                F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@shop.example")).alias("email"),
                F.concat(F.lit("Street "), F.col("c_nationkey").cast("string")).alias("address"),
                F.col("n_name").alias("city"), F.col("r_name").alias("country"),
                F.when(seg == "AUTOMOBILE", "Silver").when(seg == "MACHINERY", "Gold")
                .when(seg == "HOUSEHOLD", "Platinum").otherwise("Bronze").alias("membership_tier"),
            )
        )

    @cached_property
    def dim_customer_v0(self) -> DataFrame:
        stamp = F.lit("2023-01-01 00:00:00").cast("timestamp")
        rich = F.col("c_acctbal") > 5000

        def rows(df, sk, tier, start, end, current):
            return df.select(
                sk.cast("bigint").alias("customer_sk"), "customer_id", "customer_name",
                F.when(F.col("c_acctbal") >= 0, F.col("email")).alias("email"), "address", "city",
                "country", tier.alias("membership_tier"), start.cast("date").alias("effective_start_date"),
                F.lit(end).cast("date").alias("effective_end_date"), F.lit(current).alias("is_current"),
                stamp.alias("created_time"), stamp.alias("updated_time"),
            )

        now = rows(
            self.customers, F.col("c_custkey") + 1, F.col("membership_tier"),
            F.when(rich, F.lit("2023-07-01")).otherwise(F.lit("2023-01-01")), "9999-12-31", True,
        )
        before = rows(
            self.customers.filter(rich), -(F.col("c_custkey") + 1), F.lit("Bronze"),
            F.lit("2023-01-01"), "2023-07-01", False,
        )
        return now.unionByName(before)

    @cached_property
    def customer_snapshot(self) -> DataFrame:
        """Day's snapshot: gone, changed, emptied, filled, repeated and new customers."""
        bal = F.col("c_acctbal")
        known = self.customers.filter(bal >= -500)

        def rows(df, tier, hour):
            return df.select(
                "customer_id", "customer_name", "email",
                F.when(~bal.between(7000, 7500), F.col("address")).alias("address"), "city", "country",
                tier.alias("membership_tier"),
                F.lit(f"2024-01-16 {hour}:00:00").cast("timestamp").alias("last_updated"),
            )

        latest = rows(known, F.when(bal > 8000, F.lit("Platinum")).otherwise(F.col("membership_tier")), "12")
        morning = rows(known.filter(bal > 9500), F.lit("Gold"), "08")
        new = self.table("supplier").select(
            _id("CUST-S", "s_suppkey").alias("customer_id"), F.col("s_name").alias("customer_name"),
            F.lit(None).cast("string").alias("email"),
            F.concat(F.lit("Street "), F.col("s_nationkey").cast("string")).alias("address"),
            F.lit("unknown").alias("city"), F.lit("unknown").alias("country"),
            F.lit("Bronze").alias("membership_tier"),
            F.lit("2024-01-16 12:00:00").cast("timestamp").alias("last_updated"),
        )
        return latest.unionByName(morning).unionByName(new)

    @cached_property
    def dim_customer(self) -> DataFrame:
        return scd2_apply(
            self.dim_customer_v0, self.customer_snapshot, "customer_id", CUSTOMER_ATTRIBUTES,
            SNAPSHOT_DAY, order=[F.col("last_updated").desc()], stamp=SNAPSHOT_DAY,
        )

    # --- silver and gold --------------------------------------------------------

    @cached_property
    def silver_events(self) -> DataFrame:
        return silver.silver_user_events(self.bronze_events, processed=STAMP)

    @cached_property
    def silver_sales(self) -> DataFrame:
        return silver.silver_sales(
            self.bronze_sales, customer=F.col("buyer_id"), channel=self.channel, processed=STAMP
        )

    @cached_property
    def dim_product(self) -> DataFrame:
        return dims.dim_product(self.bronze_products, PRODUCT_DAY, stamp=STAMP)

    @cached_property
    def dim_campaign(self) -> DataFrame:
        return dims.dim_campaign(self.campaign_history, stamp=STAMP)

    @cached_property
    def fact_sales(self) -> DataFrame:
        return gold.fact_sales(self.silver_sales, self.dim_customer)

    @cached_property
    def fact_activity(self) -> DataFrame:
        return gold.fact_user_activity(self.silver_events)

    @cached_property
    def sales_performance(self) -> DataFrame:
        return gold.sales_performance(self.fact_sales, self.fact_activity)
