"""Plan shapes that must hold at scale."""

from pathlib import Path

from pyspark.sql import functions as F

from smeltry.catalog import all_queries
from smeltry.operators import aggregates as A
from smeltry.plans import features
from smeltry.quality import rules as R
from smeltry.sources.files import scan_slice
from smeltry.workload import Workload


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_per_key_is_limited_before_the_shuffle(spark, sf):
    text = plan(Workload(spark, sf).silver_sales)
    partial, shuffle, final = (text.rindex(x) for x in ("Partial", "Exchange hashpartitioning(_hash", ", Final"))
    assert final < shuffle < partial


def test_simple_rules_share_one_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    rules = [R.completeness(c) for c in df.columns] + R.value_range("l_quantity", 0, 50)
    assert plan(R.run_rules(df, "t", rules)).count("FileScan") == 1
    both = plan(R.run_rules(df, "t", rules + [R.unique("l_orderkey"), R.unique("l_partkey")]))
    assert both.count("FileScan") == 2 and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in both


def test_day_slice_reaches_the_scan(spark, sf, folder):
    Workload(spark, sf).bronze_events.drop("metadata").write.parquet(f"{folder}/events")
    text = plan(scan_slice(spark.read.parquet(f"{folder}/events"), "event_time", "2024-01-15").select("event_id"))
    assert "GreaterThanOrEqual(event_time" in text and "LessThan(event_time" in text
    assert "ReadSchema: struct<event_id:string,event_time:timestamp>" in text


def test_document_is_parsed_once(spark, sf):
    assert plan(all_queries()["parse_user_events"](spark, sf)).count("from_json") == 1


def test_frequency_and_labels_join_without_another_shuffle(spark, sf, folder):
    w = Workload(spark, sf)
    w.silver_events.write.parquet(f"{folder}/e")
    w.silver_sales.write.parquet(f"{folder}/s")
    events, sales = spark.read.parquet(f"{folder}/e"), spark.read.parquet(f"{folder}/s")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = features.recency_features(events, "2024-01-15").join(
            features.frequency_features(sales, "2024-01-15"), features.PAIR, "left"
        ).join(features.purchase_labels(sales, "2024-01-15"), features.PAIR, "left")
        assert plan(joined).count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partition_prunes_a_day(spark, sf, folder):
    w = Workload(spark, sf)
    w.bronze_events.drop("metadata").withColumn("event_day", F.to_date("event_time")).write.partitionBy("event_day").parquet(f"{folder}/e")
    stored = spark.read.parquet(f"{folder}/e")
    text = plan(scan_slice(stored, "event_time", "2024-01-15", partition="event_day"))
    part = text[text.index("PartitionFilters"):]
    assert "event_day" in part[: part.index("]")]
    one = scan_slice(stored, "event_time", "2024-01-15", partition="event_day")
    assert one.count() == scan_slice(stored, "event_time", "2024-01-15").count() > 0


def test_correlations_multiply_no_rows(spark, sf):
    text = plan(A.correlations(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_quantity", "l_tax", "l_discount"]))
    assert text.index("Generate") < text.index("HashAggregate")  # above the aggregate, over its one row


def test_building_queries_writes_nothing(spark, sf):
    home = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(home.rglob("*"))
    for name in ("feature_table", "price_rank_in_category", "hybrid_rollup", "validate_gold_layer", "cross_layer_reconciliation", "metrics_validation"):
        all_queries()[name](spark, sf)
    assert set(home.rglob("*")) == before


def test_distinct_counts_expand_no_row(spark, sf):
    from smeltry.plans import gold

    w = Workload(spark, sf)
    for df in (gold.daily_channel_sales(w.fact_sales), gold.daily_channel_sales(w.fact_sales, unique_sales=False), all_queries()["sales_performance"](spark, sf)):
        assert "Expand" not in plan(df)


def test_forty_columns_are_correlated_in_one_scan(spark, sf, folder):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 40)) @ rng.normal(size=(40, 40)) + 1e9
    x[:, 7] = 3.0
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    names = [f"x{k}" for k in range(40)]
    spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5).write.parquet(f"{folder}/wide")
    got = A.correlations(spark.read.parquet(f"{folder}/wide"), above=-1.0, digits=6)
    assert plan(got).count("FileScan") == 1
    found = {(r.column_a, r.column_b): r.r for r in got.collect()}
    for i in range(40):
        for j in range(i + 1, 40):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 7 in (i, j):
                assert (names[i], names[j]) not in found
            else:
                assert abs(found[names[i], names[j]] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 2e-6
    few = A.correlations(spark.read.parquet(f"{folder}/wide"), names[:5], above=-1.0, digits=6)
    assert all(abs(found[r.column_a, r.column_b] - r.r) < 2e-6 for r in few.collect())


def test_not_a_number_stays_in_its_pairs(spark):
    names = [f"x{k}" for k in range(10)]
    rows = [[float((k + 1) * i % 7) for k in range(10)] for i in range(30)]
    rows.append([float("nan"), None] + [1.0] * 8)
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    sums = {(r.column_a, r.column_b): r for r in A.comoments(df, names).collect()}
    assert sums["x0", "x1"].n == 30 and sums["x0", "x1"].sxy == sums["x0", "x1"].sxy
    assert sums["x0", "x2"].n == 31 and sums["x0", "x2"].sx != sums["x0", "x2"].sx
    assert sums["x2", "x3"].n == 31


def test_reprocess_prunes_untouched_days(spark, sf, folder):
    from smeltry.plans import late
    from smeltry.plans.silver import silver_sales
    from smeltry.workload import STAMP

    w = Workload(spark, sf)
    w.bronze_sales.withColumn("event_day", F.to_date("transaction_time")).write.partitionBy("event_day").parquet(f"{folder}/bronze")
    bronze = spark.read.parquet(f"{folder}/bronze")
    before = silver_sales(bronze.filter("ingestion_time < timestamp'2024-01-16'"), processed=STAMP)
    dates = late.with_arrival_delay(w.bronze_sales).filter("is_late_arrival").select("event_date").distinct().orderBy("event_date").limit(2)
    pruned = late.reprocess(bronze, before, dates, processed=STAMP, partition="event_day")
    plain = late.reprocess(bronze, before, dates, processed=STAMP)
    assert pruned.exceptAll(plain).count() == 0 and plain.exceptAll(pruned).count() == 0
    assert "dynamicpruning" in plan(late.rebuilt(bronze, dates.select(F.col("event_date").alias("_day")), partition="event_day")).lower()


def test_hashed_keys_are_unique_and_repeatable(spark):
    from smeltry.operators import rows as Rows

    df = spark.range(20_000).select(F.concat(F.lit("CUST-"), F.col("id")).alias("c"))
    keyed = lambda n: {r.c: r.sk for r in Rows.surrogate_key_hash(df.repartition(n), "c", "sk").collect()}
    one, two = keyed(3), keyed(7)
    assert one == two and len(set(one.values())) == len(one) and min(one.values()) >= 0
