"""Row-local operators at their edges."""

import pytest
from pyspark.sql import functions as F

from smeltry import schemas as S
from smeltry.functions import columns as C
from smeltry.functions import ladders as L
from smeltry.operators import rows as R
from smeltry.sources import envelope, kafka
from smeltry.sources.files import read_campaigns, scan_slice


def labels(spark, ladder, values):
    df = spark.createDataFrame([(v,) for v in values], "h double")
    return [r[0] for r in df.select(L.bucket(F.col("h"), ladder)).collect()]


def test_ladder_edges(spark):
    edges = [-2.0, 0.1, 1.0, 6.0, 24.0, 48.0, None]
    assert labels(spark, L.CONSUMER_DELAY, edges) == [
        "immediate", "immediate", "short", "medium", "long", "critical", "unknown"]
    assert labels(spark, L.MONITOR_DELAY, edges) == [
        "immediate", "short", "medium", "long", "very_long", "critical", "unknown"]
    assert labels(spark, L.BATCH_DELAY, edges[:-1]) == [
        "immediate", "immediate", "immediate", "slightly_late", "late", "very_late"]
    assert labels(spark, L.PURCHASE_DIVERSITY, [0.0, 1.0, 2.0, 3.0]) == [
        "Single Category", "Single Category", "Focused", "Diverse"]


def test_delay_of_unreadable_time(spark):
    df = spark.createDataFrame(
        [("2024-01-01T00:00:00", "2024-01-01T02:00:00"), ("soon", "2024-01-01T02:00:00"),
         ("2024-01-01T02:00:00", "2024-01-01T01:00:00"), ("2024-01-01T00:00:00", "2024-01-01T01:00:00")],
        "e string, i string",
    )
    got = [(r.delay_hours, r.delay_category, r.is_delayed) for r in R.with_delay(df, "e", "i", L.CONSUMER_DELAY).collect()]
    assert got == [(2.0, "short", True), (0.0, "unknown", False), (-1.0, "immediate", False), (1.0, "short", False)]


def test_amounts_and_currency(spark):
    df = spark.createDataFrame([(0.0, "USD"), (-1.0, "EUR"), (None, "EUR"), (10.0, "XXX"), (10.0, "GBP"), (10.0, None)], "amount double, currency string")
    assert R.positive_amount(df).count() == 3
    usd = R.to_usd(df.filter("amount = 10"), ["amount", "absent"]).collect()
    assert sorted(r.amount for r in usd) == [10.0, 10.0, 12.5] and {r.amount_original for r in usd} == {10.0}


def test_clean_strings(spark):
    df = spark.createDataFrame([("  a ",), ("   ",), ("",), (None,)], "s string")
    assert [r.s for r in R.clean_strings(df, ["s", "absent"]).collect()] == ["a", None, None, None]


def test_map_lift_defaults(spark):
    df = spark.createDataFrame([({"t": "1.5"},), ({"t": "x"},), ({},), (None,)], "m map<string,string>")
    got = [float(r.t) for r in R.lift_map(df, "m", {"t": ("decimal(10,2)", 0)}).collect()]
    assert got == [1.5, 0.0, 0.0, 0.0]


def test_conform_turns_bad_values_to_null(spark):
    df = spark.createDataFrame([("p", "1.005", "true", "2024-01-01"), ("q", "cheap", "perhaps", "never")],
                               "product_id string, base_price string, is_active string, last_updated string")
    a, b = R.conform(df, S.RAW_PRODUCT_CATALOG).collect()
    assert str(a.base_price) == "1.01" and a.is_active is True and a.last_updated is not None
    assert (b.base_price, b.is_active, b.last_updated) == (None, None, None)


def test_select_schema_orders_and_fills(spark):
    df = spark.createDataFrame([("s", "7")], "sale_id string, quantity string")
    out = R.select_schema(df, S.FACT_SALES)
    assert out.columns == [f.name for f in S.FACT_SALES.fields]
    assert out.first().quantity == 7 and out.first().customer_sk is None


def test_fill_defaults_casts(spark):
    df = spark.createDataFrame([(None, None)], "n bigint, d decimal(5,2)")
    r = R.fill_defaults(df, {"n": 999.0, "d": 0, "absent": 1}).first()
    assert r.n == 999 and str(r.d) == "0.00"


def test_validation_reasons(spark):
    e = spark.createDataFrame(
        [("1", "c", "search", "t"), (None, "c", "search", "t"), ("1", None, None, "t"), ("1", "c", "error", "t")],
        "event_id string, customer_id string, event_type string, event_time string")
    assert [r.reject_reason for r in R.validate_event(e).collect()] == [None, "missing event_id", "missing customer_id", "invalid event_type"]
    s = spark.createDataFrame(
        [("1", "Amazon", "p", "5"), ("1", "Bazaar", "p", "5"), ("1", "Amazon", "p", "0"), ("1", "Amazon", "p", "free"), ("1", "Amazon", None, "5")],
        "transaction_id string, marketplace_name string, product_id string, amount string")
    checked = R.validate_sale(s)
    assert [(r.reject_reason, r.unknown_marketplace) for r in checked.collect()] == [
        (None, False), (None, True), ("invalid amount", False), ("invalid amount", False), ("missing product_id", False)]
    clean, quarantine = R.split_valid(checked)
    assert (clean.count(), quarantine.count()) == (2, 3)


def test_slice_by_either_day(spark):
    df = spark.createDataFrame([("2024-01-01 23:59:59.999999", "2024-01-02 00:00:00"), ("2024-01-02 00:00:00", "2024-01-05 00:00:00"),
                                ("2024-01-03 00:00:00", "2024-01-05 00:00:00")], "t string, u string")
    df = df.select(F.col("t").cast("timestamp").alias("t"), F.col("u").cast("timestamp").alias("u"))
    assert scan_slice(df, "t", "2024-01-02").count() == 1
    assert scan_slice(df, "t", "2024-01-02", "u").count() == 2
    assert scan_slice(df, "t", None).count() == 3


def test_envelope(spark):
    rows = [
        ("k", '{"event_id":"1","customer_id":"c","event_type":"search","event_time":"2024-01-01T10:00:00","metadata":{"product_id":"p"},"extra":1}', "t", 0, 1),
        ("k", "{not json", "t", 0, 2), ("k", None, "t", 0, 3),
        ("k", '{"event_id":"2","event_type":"search"}', "t", 0, 4),
        ("k", '{"event_id":"3","customer_id":"c","event_type":"search","event_time":"noon"}', "t", 0, 5),
    ]
    df = spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset bigint").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    assert envelope.parse_envelope(df, S.USER_EVENT_MESSAGE).count() == 5
    parsed = envelope.parse_user_events(df).orderBy("kafka_offset").collect()
    assert [(r.event_id, r.product_id, r.event_time is not None) for r in parsed] == [("1", "p", True), ("3", None, False)]
    assert envelope.parse_user_events(df).columns == [f.name for f in S.RAW_USER_EVENTS.fields]


def test_kafka_options():
    o = kafka.kafka_options("b:9092", "marketplace_sales", "standard")
    assert o["subscribe"] == "marketplace_sales" and o["maxOffsetsPerTrigger"] == "1000"
    assert o["failOnDataLoss"] == "true" and o["startingOffsets"] == "earliest"
    tail = kafka.kafka_options("b:9092", "t", start="tail")
    assert tail["failOnDataLoss"] == "false" and tail["startingOffsets"] == "latest"
    assert "maxOffsetsPerTrigger" not in kafka.kafka_options("b:9092", "t")


def test_campaign_json_array(spark, folder):
    path = f"{folder}/campaigns.json"
    with open(path, "w") as f:
        f.write('[\n {"campaign_id":"C1","campaign_name":"A","campaign_type":"email","start_date":"2024-01-01",\n'
                '  "end_date":"2024-02-01","budget":1000.5,"target_audience":"all\\nmembers","ingestion_time":"2024-01-01T08:00:00"},\n'
                ' {"campaign_id":"C2","budget":7}\n]')
    a, b = read_campaigns(spark, path).orderBy("campaign_id").collect()
    assert str(a.start_date) == "2024-01-01" and str(a.budget) == "1000.50" and a.ingestion_time is not None
    assert b.campaign_name is None and str(b.budget) == "7.00"


def test_business_rules_sources(spark):
    df = spark.createDataFrame([("c", "a@b.c"), ("c", "nobody"), (None, "a@b.c")], "customer_id string, email string")
    assert R.business_rules(df, "customer_data").count() == 1
    assert R.business_rules(df, "unknown_source").count() == 3


@pytest.mark.parametrize("seller,want", [("SELLER-00199", "CUST-000100"), ("SELLER-00200", "CUST-000001"), ("none", None)])
def test_customer_from_seller(spark, seller, want):
    df = spark.createDataFrame([(seller,)], "s string")
    assert df.select(C.customer_from_seller(F.col("s"))).first()[0] == want
