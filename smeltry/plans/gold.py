"""Facts and business metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smeltry import schemas as S
from smeltry.functions import columns as C
from smeltry.functions.ladders import ACTIVITY_STATUS, PURCHASE_DIVERSITY, bucket
from smeltry.operators import bitmaps as B
from smeltry.operators import rows as R
from smeltry.operators.joins import temporal_join
from smeltry.sources.files import scan_slice

# Which activity counts as a visit of which sales channel.
VISIT_RULES = {
    "website": lambda: F.col("device_type").isin("desktop", "mobile", "tablet"),
    "mobile_app": lambda: (F.col("device_type") == "mobile") & F.col("page_url").like("%/app/%"),
}


def fact_sales(
    sales: DataFrame, dim_customer: DataFrame, day: date | str | None = None, history: bool = False,
    salts: int = 1,
) -> DataFrame:
    """Sales with the surrogate key of the customer version valid on their day."""
    joined = temporal_join(
        scan_slice(sales, "transaction_time", day), dim_customer, "customer_id",
        "transaction_time", ["customer_sk"], history, salts,
    )
    return R.select_schema(
        joined.withColumn("date_id", F.to_date("transaction_time")), S.FACT_SALES
    )


def fact_user_activity(events: DataFrame, day: date | str | None = None) -> DataFrame:
    if day is not None:
        events = events.filter(F.col("ingestion_date") == C.day_lit(day))
    return R.select_schema(
        events.withColumn("date_id", F.to_date("event_time")), S.FACT_USER_ACTIVITY
    )


def daily_channel_sales(fact: DataFrame, unique_sales: bool = True) -> DataFrame:
    """Revenue, sales and distinct customers per day and channel.

    A sale stands in the fact once, as the silver layer leaves it (the gold rule on
    ``sale_id`` checks it). So rows are reduced map-side to (day, channel, customer), and
    those to (day, channel): no row is expanded for a distinct count. For facts that may
    hold a sale twice ``unique_sales=False`` counts sales apart, by sale.
    """
    day = ["date_id", "channel"]
    if unique_sales:
        each = fact.groupBy(*day, "customer_sk").agg(F.sum("total_amount").alias("total_revenue"), F.count("sale_id").alias("total_transactions"))
        return _summed_again(each, day, ["total_revenue", "total_transactions"], F.count("customer_sk").alias("unique_customers"))
    each = fact.groupBy(*day, "sale_id").agg(F.sum("total_amount").alias("total_revenue"))
    sales = _summed_again(each, day, ["total_revenue"], F.count("sale_id").alias("total_transactions"))
    people = fact.groupBy(*[F.col(c).alias(f"_{c}") for c in day]).agg(F.count_distinct("customer_sk").alias("unique_customers"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in day]
    return sales.join(people, same, "inner").drop(*[f"_{c}" for c in day])


def _summed_again(df: DataFrame, keys: Sequence[str], sums: Sequence[str], *more: Column) -> DataFrame:
    """A second grouping, whose sums keep the type that the first gave them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.groupBy(*keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sums], *more)


def channel_visits(activity: DataFrame, rules: Mapping = VISIT_RULES) -> DataFrame:
    """date_id, customer_id and each channel that an event counts for."""
    counted = F.array_compact(F.array(*[F.when(rule(), F.lit(ch)) for ch, rule in rules.items()]))
    return activity.select("date_id", "customer_id", F.explode(counted).alias("channel"))


def channel_visitors(activity: DataFrame, rules: Mapping = VISIT_RULES) -> DataFrame:
    """Distinct visitors per day and channel.

    An event may count for several channels; it is expanded to those only, so a
    single distinct count serves all channels in one scan.
    """
    return channel_visits(activity, rules).groupBy("date_id", "channel").agg(F.count_distinct("customer_id").alias("total_visitors"))


def visitor_bitmaps(activity: DataFrame, numbers: DataFrame, rules: Mapping = VISIT_RULES) -> DataFrame:
    """date_id, channel, bucket, bitmap of each day's visitors, to be stored by day.

    ``numbers`` is ``bitmaps.number_keys`` of the customers. A customer's visits of a day
    are one row before numbers are looked up.
    """
    visits = channel_visits(activity, rules).distinct().join(numbers.select("customer_id", "number"), "customer_id", "inner")
    return B.key_bitmaps(visits, ["date_id", "channel"])


def visitors_of(stored: DataFrame, groups: Sequence[str] = ("channel",)) -> DataFrame:
    """Distinct visitors of stored days by coarser groups; filter ``stored`` to the days wanted."""
    return B.bitmap_totals(B.merge_bitmaps(stored, groups), groups, "total_visitors")


def sales_performance(
    fact: DataFrame, activity: DataFrame, day: date | str | None = None, rules: Mapping = VISIT_RULES,
) -> DataFrame:
    """Revenue, order value and conversion per day and channel."""
    if day is not None:
        fact = fact.filter(F.col("date_id") == C.day_lit(day))
        activity = activity.filter(F.col("date_id") == C.day_lit(day))
    both = daily_channel_sales(fact).join(
        channel_visitors(activity, rules), ["date_id", "channel"], "left"
    )
    return both.select(
        "date_id", "channel", "total_revenue", "total_transactions", "unique_customers",
        C.exact_mean(F.col("total_revenue"), F.col("total_transactions"), 2).alias("avg_transaction_value"),
        F.coalesce(C.ratio(F.col("unique_customers"), F.col("total_visitors"), 4), F.lit(0.0)).alias("conversion_rate"),
    )


def campaign_effectiveness(
    fact: DataFrame, campaigns: DataFrame, channel_map: DataFrame, day: date | str | None = None,
    unique_sales: bool = True,
) -> DataFrame:
    """Return on each campaign's budget, per day.

    ``channel_map`` rows (campaign_id, sales_channel, channel, customer_segment)
    say which sales channels a campaign is credited with and how to label it.
    Days without sales for a campaign give no row. ``unique_sales`` as in
    ``daily_channel_sales``; a plan that names a channel twice for a campaign credits it twice.
    """
    if day is not None:
        fact = fact.filter(F.col("date_id") == C.day_lit(day))
    plan = channel_map.join(
        campaigns.select("campaign_id", F.col("budget").alias("spend")), "campaign_id", "inner"
    ).withColumnRenamed("channel", "label")
    if unique_sales:
        # a sale has one channel: sums by day and channel, a few rows, are credited instead of sales
        sums = fact.groupBy("date_id", F.col("channel").alias("sales_channel")).agg(F.sum("total_amount").alias("revenue"), F.count("sale_id").alias("conversions"))
        credited = _summed_again(
            sums.join(plan, "sales_channel", "inner"), ["campaign_id", "date_id", "spend", "label", "customer_segment"], ["revenue", "conversions"]
        )
    else:
        credited = (
            fact.select("date_id", "sale_id", "total_amount", F.col("channel").alias("sales_channel"))
            .join(plan, "sales_channel", "inner")
            .groupBy("campaign_id", "date_id", "spend", "label", "customer_segment")
            .agg(F.sum("total_amount").alias("revenue"), F.count_distinct("sale_id").alias("conversions"))
        )
    credited = credited.filter("revenue IS NOT NULL")
    spend, revenue = F.col("spend"), F.col("revenue")
    return credited.select(
        "campaign_id", "date_id", "spend", "revenue",
        F.when(spend > 0, C.ratio(revenue - spend, spend, 4)).otherwise(F.lit(0.0)).alias("roi"),
        "conversions",
        F.coalesce(C.exact_mean(spend, F.col("conversions"), 2), F.lit(0)).alias("cost_per_acquisition"),
        F.col("label").alias("channel"), "customer_segment",
    )


def value_segment(transactions: Column, average: Column) -> Column:
    return (
        F.when((transactions >= 10) & (average >= 50), "High Value")
        .when((transactions >= 5) & (average >= 25), "Medium Value")
        .otherwise("Low Value")
    )


def customer_metrics(fact: DataFrame, dim_product: DataFrame, unique_sales: bool = True) -> DataFrame:
    """Per customer key: distinct sales, spend, last day, distinct categories.

    Sales that stand in the fact once look their category up and are grouped once, combined
    map-side by (customer, category): the fact is worked out once, and a hot product is
    left to AQE as elsewhere. ``unique_sales`` as in ``daily_channel_sales``; without it
    sales are counted apart, and categories on the distinct (customer, product) pairs.
    """
    known = fact.filter("customer_sk IS NOT NULL")
    if unique_sales:
        return _metrics_in_one(known, dim_product)
    totals = known.groupBy("customer_sk").agg(
        F.count_distinct("sale_id").alias("total_transactions"),
        F.sum("total_amount").alias("total_spend"),
        F.count("total_amount").alias("_amounts"),
        F.max("date_id").alias("last_purchase_date"),
    )
    categories = (
        known.select("customer_sk", "product_id").distinct()
        .join(dim_product.filter("is_current").select("product_id", "category"), "product_id", "inner")
        .groupBy(F.col("customer_sk").alias("_sk"))
        .agg(F.count_distinct("category").alias("_categories"))
    )
    return (
        totals.join(categories, F.col("customer_sk") == F.col("_sk"), "left")
        .withColumns(
            {
                "avg_transaction_value": C.exact_mean(F.col("total_spend"), F.col("_amounts"), 6),
                "unique_categories": F.coalesce("_categories", F.lit(0)),
            }
        )
        .drop("_sk", "_categories", "_amounts")
    )


def _metrics_in_one(known: DataFrame, dim_product: DataFrame) -> DataFrame:
    """`customer_metrics` of sales that stand in the fact once."""
    # a product that is current twice must not count its sales twice
    found = dim_product.filter("is_current").groupBy(F.col("product_id").alias("_id")).agg(F.collect_set("category").alias("_categories"))
    rows = known.select("customer_sk", "product_id", "sale_id", "total_amount", "date_id").join(found, F.col("product_id") == F.col("_id"), "left")
    rows = rows.select("*", F.posexplode_outer("_categories").alias("_pos", "_category"))
    once = {c: F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col(c)) for c in ("sale_id", "total_amount")}
    totals = rows.withColumns(once).groupBy("customer_sk").agg(
        F.count("sale_id").alias("total_transactions"),
        F.sum("total_amount").alias("total_spend"),
        F.count("total_amount").alias("_amounts"),
        F.max("date_id").alias("last_purchase_date"),
        F.count_distinct("_category").alias("unique_categories"),
    )
    return totals.withColumn("avg_transaction_value", C.exact_mean(F.col("total_spend"), F.col("_amounts"), 6)).select(
        "customer_sk", "total_transactions", "total_spend", "last_purchase_date", "avg_transaction_value", "unique_categories"
    )


def customer_segmentation(
    fact: DataFrame, dim_customer: DataFrame, dim_product: DataFrame, day: date | str,
) -> DataFrame:
    """Value, activity and diversity segments of current customers as of a day."""
    seen = fact.filter(F.col("date_id") <= C.day_lit(day))
    current = dim_customer.filter("is_current").select("customer_sk", "customer_id")
    m = customer_metrics(seen, dim_product).join(current, "customer_sk", "inner").withColumn(
        "days_since_last_purchase", F.date_diff(C.day_lit(day), "last_purchase_date")
    )
    return m.select(
        "customer_id",
        value_segment(F.col("total_transactions"), F.col("avg_transaction_value")).alias("value_segment"),
        bucket(F.col("days_since_last_purchase"), ACTIVITY_STATUS).alias("activity_status"),
        bucket(F.col("unique_categories"), PURCHASE_DIVERSITY).alias("purchase_diversity"),
        "total_spend", "total_transactions", "avg_transaction_value", "last_purchase_date",
        "days_since_last_purchase", C.day_lit(day).alias("segment_date"),
    )
