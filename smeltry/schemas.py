"""Declared schemas of the layered tables, in column order."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _type(name: str) -> T.DataType:
    if name.startswith("decimal("):
        precision, scale = name[len("decimal("):-1].split(",")
        return T.DecimalType(int(precision), int(scale))
    return _TYPES[name]


def _struct(fields: str) -> T.StructType:
    """A schema from "name type, name type"; needs no session, unlike DDL text."""
    pairs = (f.split(" ") for f in fields.split(", "))
    return T.StructType([T.StructField(n, _type(t), True) for n, t in pairs])


# Wire formats: times stay text until parsed.
USER_EVENT_MESSAGE = _struct(
    "event_id string, session_id string, customer_id string, event_type string, "
    "event_time string, page_url string, device_type string, "
    "metadata map<string,string>, ingestion_time string"
)
SALE_MESSAGE = _struct(
    "transaction_id string, marketplace_name string, seller_id string, product_id string, "
    "amount decimal(10,2), currency string, quantity int, transaction_time string, "
    "settlement_time string, payment_method string, status string, "
    "marketplace_metadata map<string,string>, ingestion_time string"
)
CAMPAIGN_DOCUMENT = _struct(
    "campaign_id string, campaign_name string, campaign_type string, start_date string, "
    "end_date string, budget double, target_audience string, ingestion_time string"
)
PRODUCT_DOCUMENT = _struct(
    "product_id string, product_name string, category string, subcategory string, "
    "brand string, base_price double, description string, is_active boolean, "
    "last_updated string, ingestion_time string"
)
KAFKA_ENVELOPE = _struct(
    "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
)

# Bronze.
RAW_USER_EVENTS = _struct(
    "event_id string, session_id string, customer_id string, event_type string, "
    "event_time timestamp, page_url string, product_id string, device_type string, "
    "metadata map<string,string>, ingestion_time timestamp, kafka_timestamp timestamp, "
    "kafka_partition int, kafka_offset bigint"
)
RAW_MARKETPLACE_SALES = _struct(
    "transaction_id string, marketplace_name string, seller_id string, product_id string, "
    "amount decimal(10,2), currency string, quantity int, transaction_time timestamp, "
    "settlement_time timestamp, payment_method string, status string, "
    "marketplace_metadata map<string,string>, ingestion_time timestamp, "
    "kafka_timestamp timestamp, kafka_partition int, kafka_offset bigint"
)
RAW_PRODUCT_CATALOG = _struct(
    "product_id string, product_name string, category string, subcategory string, "
    "brand string, base_price decimal(10,2), description string, is_active boolean, "
    "last_updated timestamp, ingestion_time timestamp"
)
RAW_CUSTOMER_DATA = _struct(
    "customer_id string, customer_name string, email string, address string, city string, "
    "country string, membership_tier string, created_at timestamp, last_updated timestamp, "
    "ingestion_time timestamp"
)
RAW_MARKETING_CAMPAIGNS = _struct(
    "campaign_id string, campaign_name string, campaign_type string, start_date date, "
    "end_date date, budget decimal(15,2), target_audience string, ingestion_time timestamp"
)

# Silver.
STANDARDIZED_USER_EVENTS = _struct(
    "event_id string, session_id string, customer_id string, event_type string, "
    "event_time timestamp, page_url string, product_id string, device_type string, "
    "time_spent_seconds decimal(10,2), referrer string, processed_time timestamp, "
    "ingestion_date date"
)
STANDARDIZED_SALES = _struct(
    "sale_id string, customer_id string, product_id string, channel string, quantity int, "
    "unit_price decimal(10,2), total_amount decimal(10,2), currency string, "
    "transaction_time timestamp, ingestion_time timestamp, processed_time timestamp, "
    "transaction_date date"
)
DIM_PRODUCT = _struct(
    "product_id string, product_name string, category string, subcategory string, "
    "brand string, base_price decimal(10,2), description string, is_active boolean, "
    "effective_start_date date, effective_end_date date, is_current boolean, "
    "created_time timestamp, updated_time timestamp"
)
DIM_CUSTOMER_SCD = _struct(
    "customer_sk bigint, customer_id string, customer_name string, email string, "
    "address string, city string, country string, membership_tier string, "
    "effective_start_date date, effective_end_date date, is_current boolean, "
    "created_time timestamp, updated_time timestamp"
)
DIM_MARKETING_CAMPAIGN = _struct(
    "campaign_id string, campaign_name string, campaign_type string, start_date date, "
    "end_date date, budget decimal(15,2), target_audience string, created_time timestamp, "
    "updated_time timestamp"
)
DIM_DATE = _struct(
    "date_id date, year int, month int, day int, day_of_week string, is_weekend boolean, "
    "is_holiday boolean, quarter string, week_of_year int, day_of_year int"
)
LATE_USER_EVENTS = _struct(
    "event_id string, session_id string, customer_id string, event_type string, "
    "event_timestamp timestamp, page_url string, device_type string, product_id string, "
    "category string, event_date string, event_hour int, processed_at timestamp"
)
LATE_MARKETPLACE_SALES = _struct(
    "transaction_id string, marketplace_name string, seller_id string, product_id string, "
    "amount decimal(10,2), currency string, quantity int, transaction_timestamp timestamp, "
    "settlement_timestamp timestamp, payment_method string, status string, "
    "commission_rate decimal(5,3), shipping_cost decimal(8,2), tax_amount decimal(8,2), "
    "transaction_date string, processed_at timestamp"
)

# Gold.
FACT_SALES = _struct(
    "sale_id string, product_id string, customer_sk bigint, campaign_id string, date_id date, "
    "quantity int, unit_price decimal(10,2), total_amount decimal(10,2), channel string, "
    "transaction_time timestamp, ingestion_time timestamp"
)
FACT_USER_ACTIVITY = _struct(
    "event_id string, customer_id string, product_id string, date_id date, event_type string, "
    "page_url string, device_type string, event_time timestamp, "
    "time_spent_seconds decimal(10,2), session_id string"
)
SALES_PERFORMANCE = _struct(
    "date_id date, channel string, total_revenue decimal(15,2), total_transactions bigint, "
    "unique_customers bigint, avg_transaction_value decimal(10,2), conversion_rate decimal(10,4)"
)
CUSTOMER_SEGMENTATION = _struct(
    "customer_id string, value_segment string, activity_status string, "
    "purchase_diversity string, total_spend decimal(15,2), total_transactions bigint, "
    "avg_transaction_value decimal(10,2), last_purchase_date date, "
    "days_since_last_purchase int, segment_date date"
)
CAMPAIGN_EFFECTIVENESS = _struct(
    "campaign_id string, date_id date, spend decimal(15,2), revenue decimal(15,2), "
    "roi decimal(10,4), conversions bigint, cost_per_acquisition decimal(15,2), "
    "channel string, customer_segment string"
)
CUSTOMER_PRODUCT_INTERACTIONS = _struct(
    "customer_id string, product_id string, view_count_7d bigint, view_count_30d bigint, "
    "view_count_90d bigint, purchase_count_7d bigint, purchase_count_30d bigint, "
    "cart_add_count_7d bigint, cart_add_count_30d bigint, "
    "avg_time_spent_seconds decimal(10,2), cart_abandon_flag boolean, "
    "last_interaction_days_ago int, category_purchase_count bigint, "
    "category_affinity_score decimal(5,4), customer_tenure_days int, "
    "customer_total_purchases bigint, customer_avg_order_value decimal(10,2), "
    "product_popularity_score decimal(5,4), product_avg_rating decimal(3,2), "
    "product_price_rank_in_category int, purchased_next_7d boolean, "
    "purchased_next_30d boolean, feature_date date, created_time timestamp"
)

# Long-form result of every quality check.
CHECK_RESULT = _struct(
    "table_name string, check_name string, column_name string, status string, "
    "metric string, observed double, threshold double"
)
