"""Skewed keys: balanced operators against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from smeltry.operators import aggregates as A
from smeltry.operators import joins as J
from smeltry.operators import keys as K
from smeltry.operators import upsert as U
from smeltry.plans import features, gold, late
from smeltry.streaming import events as E


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key and, within it, one price."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        key = "hot" if hot else (None if i % 97 == 1 else f"k{rng.randrange(40)}")
        rows.append((i, key, 5 if hot and i % 2 else rng.randrange(100)))
    return spark.createDataFrame(rows, "id int, category string, price int").repartition(8), rows


def test_row_number_in_steps(skewed):
    df, rows = skewed
    got = {r.id: r.rank for r in K.row_number_in_steps(df, ["category"], [F.desc("price"), F.asc("id")], -F.floor(F.col("price") / 10), "rank").collect()}
    want = {}
    for key in {r[1] for r in rows}:
        group = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))
        want.update({r[0]: n + 1 for n, r in enumerate(group)})
    assert got == want


def test_row_number_in_ranges(skewed):
    df, rows = skewed
    want = {}
    for key in {r[1] for r in rows}:
        group = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))
        want.update({r[0]: n + 1 for n, r in enumerate(group)})
    for ranges in (1, 7, 64):
        got = {r.id: r.rank for r in K.row_number_in_ranges(df, ["category"], [-F.col("price"), F.col("id")], "rank", ranges).collect()}
        assert got == want


def test_a_hot_price_is_spread_over_ranges(spark):
    rows = [(i, "a" if i % 3 else None, None if i % 7 == 1 else 5 if i % 2 else i % 50) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id int, category string, price int").repartition(6)
    order = [F.col("price").isNull(), -F.col("price"), F.col("id")]
    sizes = [r["count"] for r in K.in_ranges(df, ["category"], order, 32).groupBy("_range").count().collect()]
    assert len(sizes) >= 32 and max(sizes) <= 3 * len(rows) / 32
    ranked = K.row_number_in_ranges(df, ["category"], order, "rank", 32)
    text = ranked._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in text.split("\n") if "Window [row_number" in x]
    assert windows and all("_range" in x for x in windows)
    got = {r.id: r["rank"] for r in ranked.collect()}
    for key in ("a", None):
        group = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [got[r[0]] for r in group] == list(range(1, len(group) + 1))
    assert K.row_number_in_ranges(df.limit(0), ["category"], order, "rank").count() == 0


def test_latest_per_key(skewed):
    df, rows = skewed
    got = {r.category: r.id for r in K.latest_per_key(df, ["category"], [F.desc("price"), F.asc("id")]).collect()}
    want = {}
    for key in {r[1] for r in rows}:
        want[key] = min((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))[0]
    assert got == want


def test_top_per_group(skewed):
    df, rows = skewed
    got = Counter(r.category for r in K.top_per_group(df, ["category"], [F.asc("id")], 3).collect())
    assert got == {k: min(3, n) for k, n in Counter(r[1] for r in rows).items()}


def test_dedupe_does_not_depend_on_partitioning(spark):
    rows = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 3, "n"), (None, 1, "m")]
    one = K.dedupe(spark.createDataFrame(rows, "k string, v int, s string").coalesce(1), ["k"])
    two = K.dedupe(spark.createDataFrame(rows[::-1], "k string, v int, s string").repartition(5), ["k"])
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert {(r.k, r.v, r.s) for r in one.collect()} == {("a", 1, "y"), (None, 1, "m")}
    assert K.dedupe(one, ["k"]).count() == one.count()


def test_spread_index_is_unique_and_repeatable(spark):
    df = spark.range(5000).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("k"))
    a = {r.k: r.sk for r in K.spread_index(df.repartition(7), "k", "sk", start=10).collect()}
    b = {r.k: r.sk for r in K.spread_index(df.coalesce(1), "k", "sk", start=10).collect()}
    assert a == b and len(set(a.values())) == 5000 and min(a.values()) > 10


def test_duplicate_members_lists_every_row(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("b", 3, 1), (None, 4, 1), (None, 5, 2)], "k string, m int, t int")
    got = sorted(((r.k or ""), r.m, r.duplicate_count, r.latest_ingestion) for r in K.duplicate_members(df, ["k"], "m", "t").collect())
    assert got == [("", 4, 2, 2), ("", 5, 2, 2), ("a", 1, 2, 5), ("a", 2, 2, 5)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    df, _ = skewed
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "name string, v int")
    plain = df.join(right, df.category == right.name, how)
    salted = J.salted_join(df, right, "category", "name", how, 5)
    assert sorted(map(str, plain.select("id", "name", "v").collect())) == sorted(map(str, salted.select("id", "name", "v").collect()))


def test_salted_join_spreads_the_hot_key(spark, skewed):
    df, _ = skewed
    right = spark.createDataFrame([("hot", 1)], "name string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = (
            J.salted_join(df, right, "category", "name", "inner", 16)
            .groupBy(F.spark_partition_id().alias("p")).count().collect()
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 3 and max(r["count"] for r in parts) < 700


def test_salted_left_join_keeps_rows_without_key(spark):
    df = spark.range(60).select(F.when(F.col("id") % 3 > 0, F.lit("a")).alias("k"), "id")
    right = spark.createDataFrame([("a", 1)], "name string, v int")
    out = J.salted_join(df, right, "k", "name", "left", 4).collect()
    assert len(out) == 60 and sum(r.v is None for r in out) == 20


def test_orphans_counts_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "fk int")
    parent = spark.createDataFrame([(2, True), (1, False)], "fk int, is_current boolean")
    assert {(r.fk, r.rows) for r in J.orphans(df, "fk", parent).collect()} == {(1, 2), (3, 1)}


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    once = U.upsert(t, s, ["k"], [F.desc("n")])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, U.upsert(once, s, ["k"], [F.desc("n")]).collect())) == sorted(map(tuple, once.collect()))


def test_replace_slice_can_empty_a_day(spark):
    t = spark.createDataFrame([("d1", 1), ("d2", 2), ("d3", 3)], "d string, v int")
    fresh = spark.createDataFrame([("d2", 9)], "d string, v int")
    dates = spark.createDataFrame([("d2",), ("d3",)], "d string")
    assert sorted(map(tuple, U.replace_slice(t, fresh, "d", dates).collect())) == [("d1", 1), ("d2", 9)]


def test_sessions_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"u{rng.randrange(5)}", rng.randrange(0, 400_000)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "u string, s bigint").select("u", F.timestamp_seconds("s").alias("t"))
    got = Counter((r.u, r.events) for r in E.session_activity(df, "u", "t", "5 minutes").collect())
    want = Counter()
    for u in {r[0] for r in rows}:
        times = sorted(s for k, s in rows if k == u)
        size = 1
        for a, b in zip(times, times[1:]):
            if b - a > 300:
                want[(u, size)] += 1
                size = 0
            size += 1
        want[(u, size)] += 1
    assert got == want


def test_zero_visitors_and_zero_spend(spark):
    fact = spark.createDataFrame(
        [("s1", 1, "2024-01-01", "shop", "10.00"), ("s2", None, "2024-01-01", "shop", "5.00")],
        "sale_id string, customer_sk bigint, date_id string, channel string, total_amount string",
    ).withColumns({"date_id": F.col("date_id").cast("date"), "total_amount": F.col("total_amount").cast("decimal(10,2)")})
    activity = spark.createDataFrame([], "date_id date, customer_id string, device_type string, page_url string")
    r = gold.sales_performance(fact, activity).first()
    assert (r.total_transactions, r.unique_customers, float(r.avg_transaction_value), r.conversion_rate) == (2, 1, 7.5, 0.0)
    campaigns = spark.createDataFrame([("c", 0), ("quiet", 5)], "campaign_id string, budget int")
    plan = spark.createDataFrame([("c", "shop", "shop", "x"), ("quiet", "none", "none", "x")],
                                 "campaign_id string, sales_channel string, channel string, customer_segment string")
    out = gold.campaign_effectiveness(fact, campaigns, plan).collect()
    assert [(r.campaign_id, r.roi, float(r.cost_per_acquisition)) for r in out] == [("c", 0.0, 0.0)]


def test_label_bounds(spark):
    days = ["2024-01-14", "2024-01-15", "2024-01-22", "2024-01-23", "2024-02-13", "2024-02-14"]
    df = spark.createDataFrame([(f"c{i}", "p", d) for i, d in enumerate(days)], "customer_id string, product_id string, d string")
    sales = df.withColumn("transaction_time", F.col("d").cast("timestamp"))
    loose = {r.customer_id: r.purchased_next_7d for r in features.purchase_labels(sales, "2024-01-15").collect()}
    assert loose == {"c1": True, "c2": True, "c3": False, "c4": False}
    strict = {r.customer_id: r.purchased_next_7d for r in features.purchase_labels(sales, "2024-01-15", strict=True).collect()}
    assert strict == {"c2": True, "c3": False, "c4": False, "c5": False}


def test_value_segment_edges(spark):
    df = spark.createDataFrame([(10, 50.0), (10, 49.9), (9, 80.0), (5, 25.0), (4, 99.0)], "n int, a double")
    got = [r[0] for r in df.select(gold.value_segment(F.col("n"), F.col("a"))).collect()]
    assert got == ["High Value", "Medium Value", "Medium Value", "Medium Value", "Low Value"]


def test_reprocess_equals_full_transform(spark, sf):
    from smeltry.plans.silver import silver_sales
    from smeltry.workload import STAMP, Workload

    w = Workload(spark, sf)
    seen = w.bronze_sales.filter("ingestion_time < timestamp'2024-01-16'")
    before = silver_sales(seen, processed=STAMP)
    dates = late.with_arrival_delay(w.bronze_sales).select("event_date")
    repaired = late.reprocess(w.bronze_sales, before, dates, processed=STAMP)
    whole = silver_sales(w.bronze_sales, processed=STAMP)
    assert repaired.exceptAll(whole).count() == 0 and whole.exceptAll(repaired).count() == 0


def test_upsert_inserts_every_row_without_a_key(spark):
    shape = "k string, v int, t int"
    target = spark.createDataFrame([("a", 1, 0)], shape)
    source = spark.createDataFrame([(None, 2, 1), (None, 3, 1), ("a", 4, 1), ("a", 5, 2)], shape)
    got = sorted((r.k or "", r.v) for r in U.upsert(target, source, ["k"], [F.desc("t")]).collect())
    assert got == [("", 2), ("", 3), ("a", 5)]


def test_replace_slice_of_rows_without_a_date(spark):
    target = spark.createDataFrame([("a", None), ("b", "x")], "id string, d string")
    fresh = spark.createDataFrame([("c", None)], "id string, d string")
    assert sorted(r.id for r in U.replace_slice(target, fresh, "d").collect()) == ["b", "c"]


def test_dedupe_compares_maps(spark):
    rows = [(1, {"a": "2"}), (1, {"a": "1"})]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "k int, m map<string,string>").coalesce(1)
        assert K.dedupe(df, ["k"]).first().m == {"a": "1"}


def test_exact_quantiles_beyond_a_million_rows(spark):
    df = spark.range(1_300_001).select((F.col("id") * 7919 % 1_300_001).alias("v"), F.lit(1.5).alias("same"))
    assert tuple(A.exact_quantiles(df, ["v", "same"], accuracy=100).first()) == (325000, 975000, 1.5, 1.5)
    near = A.quantiles(df, ["v"]).first()
    assert abs(near.v_q1 - 325000) <= 131 and abs(near.v_q3 - 975000) <= 131
    nothing = A.exact_quantiles(df.filter("v < 0"), ["v"]).first()
    assert nothing.v_q1 is None
    some = A.exact_quantiles(df.withColumn("none", F.when(F.col("v") < 0, 1)), ["none", "v"]).first()
    assert (some.none_q1, some.v_q3) == (None, 975000)


def test_exact_quantiles_narrow_until_few_values_are_left(spark, monkeypatch):
    n = 400_001
    df = spark.range(n).select((F.col("id") * 7919 % n - 5).alias("v"), F.when(F.col("id") % 10 > 0, 3.5).otherwise(F.col("id") / 7).alias("hot"))
    scans = []
    within = A._Bracket.around
    monkeypatch.setattr(A._Bracket, "around", lambda s, accuracy: scans.append(s.name) or within(s, accuracy))
    got = A.exact_quantiles(df, ["v"], accuracy=100, probs={"m": 0.5, "p": 0.901}, at_most=50).first()
    assert tuple(got) == (200_000 - 5, math.ceil(n * 0.901) - 6)
    assert scans.count("m") >= 3 and scans.count("p") >= 3
    # a value that fills the bracket alone ends the rounds
    assert A.exact_quantiles(df, ["hot"], accuracy=100, at_most=1).first().hot_q1 == 3.5
    two = spark.range(1000).select((F.col("id") % 2).alias("v"))
    assert tuple(A.exact_quantiles(two, ["v"], accuracy=100, probs={"m": 0.5, "n": 0.501}, at_most=1).first()) == (0, 1)
    days = spark.range(1001).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("d"), F.col("id").cast("decimal(9,2)").alias("m"))
    assert [str(x) for x in A.exact_quantiles(days, ["d", "m"], accuracy=100, probs={"q": 0.25}, at_most=2).first()] == ["2024-09-07", "250.00"]


def test_visitors_of_stored_days_equal_a_recount(spark, folder):
    from smeltry.operators import bitmaps as B

    rng = random.Random(3)
    rows = [(f"2024-01-{rng.randrange(1, 15):02}", f"c{rng.randrange(300)}" if rng.random() < 0.95 else None, rng.choice(["desktop", "mobile", "tv"]), rng.choice(["/app/x", "/y/app/z", "/q"])) for _ in range(4000)]
    activity = spark.createDataFrame(rows, "date_id string, customer_id string, device_type string, page_url string").withColumn("date_id", F.col("date_id").cast("date"))
    early, late_ = activity.filter("date_id < '2024-01-08'"), activity.filter("date_id >= '2024-01-08'")
    numbers = B.number_keys(early, "customer_id", hex_digits=1)
    more = B.number_keys(late_, "customer_id", numbers, hex_digits=1)
    kept = {r.customer_id: r.number for r in more.collect()}
    assert len(set(kept.values())) == len(kept) == 300 and all(kept[r.customer_id] == r.number for r in numbers.collect())
    for part, known in ((early, numbers), (late_, more)):  # a run for each week, days stored apart
        gold.visitor_bitmaps(part, known).write.mode("append").partitionBy("date_id").parquet(f"{folder}/bits")
    stored = spark.read.parquet(f"{folder}/bits")
    week = stored.filter("date_id BETWEEN '2024-01-04' AND '2024-01-10'")
    want = activity.filter("date_id BETWEEN '2024-01-04' AND '2024-01-10'")
    recount = gold.channel_visits(want).groupBy("channel").agg(F.count_distinct("customer_id").alias("n"))
    assert {r.channel: r.total_visitors for r in gold.visitors_of(week).collect()} == {r.channel: r.n for r in recount.collect()}
    days = {(r.date_id, r.channel): r.total_visitors for r in gold.visitors_of(stored, ["date_id", "channel"]).collect()}
    assert days == {(r.date_id, r.channel): r.total_visitors for r in gold.channel_visitors(activity).collect() if r.total_visitors}


def test_sales_that_stand_twice(spark):
    rows = [("s1", 1, "2024-01-01", "shop", 10), ("s1", 2, "2024-01-01", "shop", 5), ("s2", 1, "2024-01-01", "shop", 1), (None, None, "2024-01-01", None, 2)]
    fact = spark.createDataFrame(rows, "sale_id string, customer_sk bigint, date_id string, channel string, total_amount int").withColumn("date_id", F.col("date_id").cast("date"))
    got = {r.channel: tuple(r)[2:] for r in gold.daily_channel_sales(fact, unique_sales=False).select("date_id", "channel", "total_revenue", "total_transactions", "unique_customers").collect()}
    assert got == {"shop": (16, 2, 2), None: (2, 0, 0)}
    assert {r.channel: r.unique_customers for r in gold.daily_channel_sales(fact).collect()} == {"shop": 2, None: 0}
