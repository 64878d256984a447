"""Joins."""


from smeltry.catalog.registry import query
from smeltry.catalog.tables import ATTRS, big, day, dbl, each, ts
from smeltry.operators import history as H
from smeltry.operators import joins as J
from smeltry.plans import features, gold

FACT_SQL = f"""SELECT sale_id, product_id, customer_sk, CAST(NULL AS VARCHAR) AS campaign_id, {day('date_id')},
  {big('quantity')}, {each(dbl, 'unit_price', 'total_amount')}, channel, {each(ts, 'transaction_time', 'ingestion_time')}"""

HISTORY_SQL = f"""{FACT_SQL} FROM (
  SELECT s.*, s.transaction_date AS date_id, c.customer_sk FROM silver_sales s LEFT JOIN dim_customer c
    ON s.customer_id = c.customer_id AND s.transaction_date >= c.effective_start_date
    AND s.transaction_date < coalesce(c.effective_end_date, DATE '9999-12-31'))"""


@query("temporal_join_current", f"{FACT_SQL} FROM fact_sales")
def _(w):
    return w.fact_sales


@query("temporal_join_history", HISTORY_SQL)
def _(w):
    return gold.fact_sales(w.silver_sales, w.dim_customer, history=True)


@query("temporal_join_salted", HISTORY_SQL)
def _(w):
    return gold.fact_sales(w.silver_sales, w.dim_customer, history=True, salts=8)


@query(
    "new_keys",
    "SELECT DISTINCT customer_id FROM customer_snapshot WHERE customer_id NOT IN (SELECT customer_id FROM dim_customer_v0)",
)
def _(w):
    return J.new_keys(w.customer_snapshot, w.dim_customer_v0, ["customer_id"])


@query(
    "changed_rows",
    f"""SELECT s.customer_id, {', '.join('s.' + a for a in ATTRS)}, c.customer_sk AS current_customer_sk
    FROM customer_snapshot s JOIN dim_customer_v0 c ON s.customer_id = c.customer_id AND c.is_current
    WHERE {' OR '.join(f's.{a} IS DISTINCT FROM c.{a}' for a in ATTRS)}""",
)
def _(w):
    return J.changed_rows(
        w.customer_snapshot, w.dim_customer_v0.filter("is_current"), ["customer_id"],
        H.CUSTOMER_ATTRIBUTES, carry=["customer_sk"],
    )


@query(
    "star_join",
    f"""SELECT f.sale_id, c.customer_id, c.country, p.category, {dbl('f.total_amount', 'total_amount')}
    FROM fact_sales f JOIN dim_customer c ON f.customer_sk = c.customer_sk AND c.is_current
    LEFT JOIN dim_product p ON f.product_id = p.product_id""",
)
def _(w):
    customers = w.dim_customer.filter("is_current").select("customer_sk", "customer_id", "country")
    products = w.dim_product.filter("is_current").select("product_id", "category")
    return (
        w.fact_sales.join(customers, "customer_sk", "inner").join(products, "product_id", "left")
        .select("sale_id", "customer_id", "country", "category", "total_amount")
    )


@query(
    "channel_sales_with_visitors",
    f"""SELECT {day('d.date_id', 'date_id')}, d.channel, {big('d.unique_customers', 'unique_customers')}, v.total_visitors
    FROM daily_sales d LEFT JOIN channel_visitors v ON d.date_id = v.date_id AND d.channel = v.channel""",
)
def _(w):
    return (
        gold.daily_channel_sales(w.fact_sales)
        .join(gold.channel_visitors(w.fact_activity), ["date_id", "channel"], "left")
        .select("date_id", "channel", "unique_customers", "total_visitors")
    )


@query(
    "orphan_keys",
    """SELECT customer_id, count(*) AS rows FROM silver_events WHERE customer_id IS NOT NULL
      AND customer_id NOT IN (SELECT customer_id FROM customers WHERE c_acctbal > 0) GROUP BY customer_id""",
)
def _(w):
    parent = w.customers.filter("c_acctbal > 0").select("customer_id")
    return J.orphans(w.silver_events, "customer_id", parent)


@query(
    "sales_with_current_product",
    f"""SELECT s.sale_id, s.product_id, p.category, p.brand, {dbl('p.base_price', 'base_price')}
    FROM silver_sales s JOIN dim_product p ON s.product_id = p.product_id""",
)
def _(w):
    products = w.dim_product.filter("is_current").select("product_id", "category", "brand", "base_price")
    return w.silver_sales.select("sale_id", "product_id").join(products, "product_id", "inner")


@query(
    "recent_purchases",
    f"""SELECT p.product_id, p.category, {dbl('p.base_price', 'base_price')}, coalesce(s.n, 0) AS recent_purchases
    FROM dim_product p LEFT JOIN (SELECT product_id, count(*) AS n FROM silver_sales
      WHERE transaction_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY product_id) s ON p.product_id = s.product_id""",
)
def _(w):
    return features.recent_purchases(w.silver_sales, w.dim_product, "2024-01-31")


@query(
    "as_of_dimension",
    f"""SELECT customer_sk, customer_id, membership_tier, {each(day, 'effective_start_date', 'effective_end_date')}, is_current FROM dim_customer
    WHERE effective_start_date <= DATE '2023-12-31' AND coalesce(effective_end_date, DATE '9999-12-31') > DATE '2023-12-31'""",
)
def _(w):
    return H.as_of(w.dim_customer, "2023-12-31").select(
        "customer_sk", "customer_id", "membership_tier", "effective_start_date", "effective_end_date", "is_current"
    )
