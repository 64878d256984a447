"""Merged slices against whole profiles."""

from pyspark.sql import functions as F

from smeltry.operators import aggregates as A
from smeltry.profiling import profile as P
from smeltry.profiling import sketches as S
from smeltry.workload import Workload


def values(df):
    return {(r.column_name, r.metric): r.value for r in df.collect()}


def frame(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("day", F.to_date("l_shipdate"))
    return lines.withColumns({"part": F.when(F.col("l_partkey") % 11 > 0, F.col("l_partkey")), "never": F.lit(None).cast("int"), "big": F.col("l_tax") + 1e9})


def test_merged_days_are_near_a_whole_profile(spark, sf):
    df = frame(spark, sf)
    got = values(S.merged_profile(S.slice_sketches(df, F.year("day").cast("string").cast("date"))))
    want = values(P.profile_numeric(df)) | values(P.profile_string(df))
    for c in A.numeric_columns(df):
        for m in ("count", "null_count", "min", "max"):
            assert got[c, m] == want[c, m]
        for m in ("mean", "stddev"):
            assert got[c, m] == want[c, m] or abs(got[c, m] - want[c, m]) <= 1e-5 * abs(want[c, m])
        assert abs(got[c, "distinct_count"] - want[c, "distinct_count"]) <= 1 + 0.05 * want[c, "distinct_count"]
        ordered = sorted(r[0] for r in df.select(F.col(c).cast("double")).collect() if r[0] is not None)
        for m, p in S.MERGED.items():
            if ordered:
                low, high = (ordered[min(len(ordered) - 1, max(0, int(len(ordered) * (p + d))))] for d in (-0.02, 0.02))
                assert low <= got[c, m] <= high
            else:
                assert got[c, m] is None
    for c in P.string_columns(df):
        assert got[c, "null_count"] == want[c, "null_count"] and got[c, "max"] == want[c, "max_length"] and abs(got[c, "mean"] - want[c, "avg_length"]) < 1e-9
        assert abs(got[c, "distinct_count"] - want[c, "distinct_count"]) <= 1 + 0.05 * want[c, "distinct_count"]


def test_slices_come_from_one_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    text = S.slice_sketches(df, F.to_date("l_shipdate"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Expand" not in text


def test_stored_days_are_replaced(spark, sf):
    for t in ("events_s", "slices_s"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    events = Workload(spark, sf).bronze_events.drop("metadata").withColumn("event_day", F.to_date("event_time"))
    events.write.partitionBy("event_day").saveAsTable("events_s")
    stored = spark.table("events_s")
    days = stored.select(F.col("event_day").alias("day")).distinct()
    S.refresh_slices(stored, "slices_s", "event_day", days.filter("day < '2024-01-20'"))
    S.refresh_slices(stored, "slices_s", "event_day", days.filter("day >= '2024-01-20'"))
    whole = values(S.merged_profile(S.slice_sketches(stored.drop("event_day"), F.to_date("event_time"))))
    got = values(S.merged_profile(spark.table("slices_s")))
    assert got.keys() == whole.keys()
    for (c, m), v in whole.items():
        near = 0.02 if m == "distinct_count" else 1e-9
        assert got[c, m] == v or abs(got[c, m] - v) <= near * abs(v)
    spark.sql("ALTER TABLE events_s DROP PARTITION (event_day = '2024-01-05')")
    spark.catalog.refreshTable("events_s")
    before = set(spark.table("slices_s").inputFiles())
    S.refresh_slices(spark.table("events_s"), "slices_s", "event_day", spark.sql("SELECT date'2024-01-05' AS day"))
    spark.catalog.refreshTable("slices_s")
    after = set(spark.table("slices_s").inputFiles())
    assert after < before and all("2024-01-05" in f for f in before - after)
    for t in ("events_s", "slices_s"):
        spark.sql(f"DROP TABLE {t}")


def test_no_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").limit(0)
    assert S.merged_profile(S.slice_sketches(df, F.to_date("l_shipdate"))).count() == 0
