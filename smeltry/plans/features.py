"""Point-in-time features per (customer, product)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smeltry import schemas as S
from smeltry.functions import columns as C
from smeltry.operators import aggregates as A
from smeltry.operators import keys as K
from smeltry.operators import rows as R

PAIR = ["customer_id", "product_id"]

# --- fixed values: what an absent feature means --------------------------------
DEFAULTS = {
    "view_count_7d": 0, "view_count_30d": 0, "view_count_90d": 0,
    "purchase_count_7d": 0, "purchase_count_30d": 0,
    "cart_add_count_7d": 0, "cart_add_count_30d": 0,
    "avg_time_spent_seconds": 0.0, "image_view_ratio": 0.0, "cart_abandon_flag": False,
    "last_interaction_days_ago": 999, "category_purchase_count": 0,
    "category_affinity_score": 0.0, "customer_tenure_days": 0, "customer_total_purchases": 0,
    "customer_avg_order_value": 0.0, "product_popularity_score": 0.0, "product_avg_rating": 3.0,
    "product_price_rank_in_category": 999, "purchased_next_7d": False, "purchased_next_30d": False,
}
# -------------------------------------------------------------------------------

VIEW = ("product_view",)
CART = ("add_to_cart",)
PURCHASE = ("purchase", "purchase_complete")


def _back(as_of: date | str, days: int) -> date:
    return C.as_date(as_of) - timedelta(days=days)


def recency_features(
    events: DataFrame, as_of: date | str, views: Sequence[str] = VIEW, carts: Sequence[str] = CART,
    purchases: Sequence[str] = PURCHASE, image_view_ratio: bool = False,
) -> DataFrame:
    """Interaction counts over 7, 30 and 90 days up to and including ``as_of``."""
    recent = events.filter(
        C.in_days("event_time", _back(as_of, 90), as_of)
        & F.col("customer_id").isNotNull() & F.col("product_id").isNotNull()
    ).select(
        *PAIR, "event_type", "time_spent_seconds",
        C.days_before(as_of, F.col("event_time")).alias("_ago"),
    )
    view = F.col("event_type").isin(list(views))
    cart = F.col("event_type").isin(list(carts))
    bought = F.col("event_type").isin(list(purchases))
    ago = F.col("_ago")
    spent = F.when(view, F.col("time_spent_seconds"))
    aggs = [
        A.count_within(view, ago, 7).alias("view_count_7d"),
        A.count_within(view, ago, 30).alias("view_count_30d"),
        A.count_within(view, ago, 90).alias("view_count_90d"),
        A.count_within(cart, ago, 7).alias("cart_add_count_7d"),
        A.count_within(cart, ago, 30).alias("cart_add_count_30d"),
        C.exact_mean(F.sum(spent), F.count(spent), 2).alias("avg_time_spent_seconds"),
        F.min(ago).alias("last_interaction_days_ago"),
        (F.coalesce(F.bool_or(cart), F.lit(False)) & ~F.coalesce(F.bool_or(bought), F.lit(False))).alias("cart_abandon_flag"),
    ]
    if image_view_ratio:
        aggs.append(C.ratio(F.count_if(view), F.count(F.lit(1)), 4).alias("image_view_ratio"))
    return recent.groupBy(*PAIR).agg(*aggs)


def frequency_features(sales: DataFrame, as_of: date | str) -> DataFrame:
    """Purchase counts over 7 and 30 days."""
    ago = C.days_before(as_of, F.col("transaction_time"))
    always = F.lit(True)
    return sales.filter(C.in_days("transaction_time", _back(as_of, 30), as_of)).groupBy(*PAIR).agg(
        A.count_within(always, ago, 7).alias("purchase_count_7d"),
        A.count_within(always, ago, 30).alias("purchase_count_30d"),
    )


def category_affinity(sales: DataFrame, dim_product: DataFrame, as_of: date | str) -> DataFrame:
    """Purchases of each customer per category over 90 days and their share of all.

    Sales are reduced to (customer, product) before the product lookup.
    """
    bought = (
        sales.filter(C.in_days("transaction_time", _back(as_of, 90), as_of))
        .groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_n"))
    )
    per_category = (
        bought.join(dim_product.filter("is_current").select("product_id", "category"), "product_id", "inner")
        .groupBy("customer_id", "category")
        .agg(F.sum("_n").alias("category_purchase_count"))
    )
    return A.share_of_group(
        per_category, ["customer_id"], "category_purchase_count", "category_affinity_score"
    )


def affinity_for_pairs(affinity: DataFrame, pairs: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Category affinity of given (customer, product) pairs.

    Only pairs that are asked for are looked up; customers are never multiplied
    by all products of a category.
    """
    products = dim_product.filter("is_current").select("product_id", "category")
    return (
        pairs.select(*PAIR).join(products, "product_id", "inner")
        .join(affinity, ["customer_id", "category"], "inner")
        .select(*PAIR, "category_purchase_count", "category_affinity_score")
    )


def purchases_of_pairs(sales: DataFrame, as_of: date | str, strict: bool = False) -> DataFrame:
    """``frequency_features`` and ``purchase_labels`` of all pairs, in one grouping of the sales.

    A pair with purchases on one side of ``as_of`` only has counts of 0, or no labels.
    """
    start = C.as_date(as_of)
    first, last = _label_days(as_of, strict)
    t = F.col("transaction_time")
    before, after = C.in_days("transaction_time", _back(as_of, 30), as_of), C.in_days("transaction_time", first, last)
    ago = C.days_before(as_of, t)
    return (
        sales.filter(before | after).groupBy(*PAIR)
        .agg(
            A.count_within(before, ago, 7).alias("purchase_count_7d"),
            A.count_within(before, ago, 30).alias("purchase_count_30d"),
            F.min(F.when(after, F.to_date(t))).alias("_first"),
        )
        .select(
            *PAIR, "purchase_count_7d", "purchase_count_30d",
            (F.col("_first") <= C.day_lit(start + timedelta(days=7))).alias("purchased_next_7d"),
            F.when(F.col("_first").isNotNull(), F.lit(True)).alias("purchased_next_30d"),
        )
    )


def customer_features(sales: DataFrame, as_of: date | str) -> DataFrame:
    """Tenure, number of purchases and mean order value up to ``as_of``."""
    until = F.col("transaction_time") < F.date_add(C.day_lit(as_of), 1).cast("timestamp")
    return sales.filter(until).groupBy("customer_id").agg(
        C.days_before(as_of, F.min("transaction_time")).alias("customer_tenure_days"),
        F.count(F.lit(1)).alias("customer_total_purchases"),
        C.exact_mean(F.sum("total_amount"), F.count("total_amount"), 2).alias("customer_avg_order_value"),
    )


def recent_purchases(sales: DataFrame, dim_product: DataFrame, as_of: date | str, days: int = 30) -> DataFrame:
    """Current products with their purchase count over the last days, 0 when none."""
    counts = (
        sales.filter(C.in_days("transaction_time", _back(as_of, days), as_of))
        .groupBy("product_id").agg(F.count(F.lit(1)).alias("recent_purchases"))
    )
    return (
        dim_product.filter("is_current").select("product_id", "category", "base_price")
        .join(counts, "product_id", "left")
        .withColumn("recent_purchases", F.coalesce("recent_purchases", F.lit(0)))
    )


def price_rank_in_category(dim_product: DataFrame) -> DataFrame:
    """Rank of each current product by price, dearest first, ties by product id."""
    price = F.col("base_price")
    return K.row_number_in_ranges(
        dim_product.filter("is_current").select("product_id", "category", "base_price"),
        ["category"], [price.isNull(), -price, F.col("product_id")], "product_price_rank_in_category",
    )


def product_features(
    sales: DataFrame, dim_product: DataFrame, as_of: date | str, ratings: DataFrame | None = None,
) -> DataFrame:
    """Popularity within the category, price rank and mean rating of current products.

    ``ratings`` (product_id, product_avg_rating) is optional; without it, or for
    products it lacks, the rating is 3.0.
    """
    popular = A.share_of_group_max(
        recent_purchases(sales, dim_product, as_of), "category", "recent_purchases",
        "product_popularity_score",
    ).select("product_id", "product_popularity_score")
    ranks = price_rank_in_category(dim_product).select("product_id", "product_price_rank_in_category")
    out = popular.join(ranks, "product_id", "inner")
    if ratings is not None:
        out = out.join(ratings.select("product_id", "product_avg_rating"), "product_id", "left")
    else:
        out = out.withColumn("product_avg_rating", F.lit(None).cast("double"))
    return out.select(
        "product_id", "product_popularity_score",
        F.coalesce("product_avg_rating", F.lit(3.0)).cast("decimal(3,2)").alias("product_avg_rating"),
        "product_price_rank_in_category",
    )


def _label_days(as_of: date | str, strict: bool) -> tuple[date, date]:
    start = C.as_date(as_of)
    return start + timedelta(days=1 if strict else 0), start + timedelta(days=30 if strict else 29)


def purchase_labels(sales: DataFrame, as_of: date | str, strict: bool = False) -> DataFrame:
    """Whether a pair is bought again within 7 and 30 days.

    By default ``as_of`` itself counts, day 7 is included and day 30 is not.
    ``strict`` uses ``(as_of, as_of + n]`` for both, so that no label day is also
    a feature day.
    """
    start = C.as_date(as_of)
    first, last = _label_days(as_of, strict)
    return (
        sales.filter(C.in_days("transaction_time", first, last))
        .groupBy(*PAIR)
        .agg(F.min(F.to_date("transaction_time")).alias("_first"))
        .select(
            *PAIR,
            (F.col("_first") <= C.day_lit(start + timedelta(days=7))).alias("purchased_next_7d"),
            F.lit(True).alias("purchased_next_30d"),
        )
    )


def base_pairs(events: DataFrame, as_of: date | str) -> DataFrame:
    """Distinct pairs that interacted within 90 days."""
    return events.filter(
        C.in_days("event_time", _back(as_of, 90), as_of)
        & F.col("customer_id").isNotNull() & F.col("product_id").isNotNull()
    ).select(*PAIR).distinct()


def assemble_features(
    recency: DataFrame, frequency: DataFrame, affinity: DataFrame, customers: DataFrame,
    products: DataFrame, labels: DataFrame | None, dim_product: DataFrame,
) -> DataFrame:
    """Left joins of all feature groups onto the interacting pairs.

    The recency groups are exactly the distinct base pairs, so they start the
    chain. Frequency and labels are keyed and partitioned like them and join
    without a further shuffle; ``labels`` may be None when frequency holds them. Product features are put beside the category on
    the dimension's side, so that the pairs meet the products once; affinity
    then joins by (customer, category).
    """
    catalogue = dim_product.filter("is_current").select("product_id", "category").join(
        products, "product_id", "left"
    )
    purchases = recency.join(frequency, PAIR, "left")
    return (
        (purchases if labels is None else purchases.join(labels, PAIR, "left"))
        .join(catalogue, "product_id", "left")
        .join(affinity, ["customer_id", "category"], "left")
        .join(customers, "customer_id", "left")
        .drop("category")
    )


def feature_table(
    events: DataFrame, sales: DataFrame, dim_product: DataFrame, as_of: date | str,
    ratings: DataFrame | None = None, strict_labels: bool = False, stamp: datetime | None = None,
) -> DataFrame:
    """The feature table of a day, in its declared schema."""
    joined = assemble_features(
        recency_features(events, as_of), purchases_of_pairs(sales, as_of, strict_labels),
        category_affinity(sales, dim_product, as_of), customer_features(sales, as_of),
        product_features(sales, dim_product, as_of, ratings),
        None, dim_product,
    )
    now = (F.lit(stamp) if stamp is not None else F.current_timestamp()).cast("timestamp")
    filled = R.fill_defaults(joined, DEFAULTS).withColumns(
        {"feature_date": C.day_lit(as_of), "created_time": now}
    )
    return R.select_schema(filled, S.CUSTOMER_PRODUCT_INTERACTIONS)
