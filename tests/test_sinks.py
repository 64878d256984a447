"""Writers against real files."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from smeltry.plans import late
from smeltry.profiling.profile import file_health
from smeltry.sources import sinks
from smeltry.workload import STAMP, Workload


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, v string, d string").withColumn("d", F.col("d").cast("date"))


def content(spark, table):
    return sorted((r.k, r.v, str(r.d)) for r in spark.table(table).collect())


@pytest.fixture()
def table(spark):
    name = "sales_t"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    frame(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-02")]).write.partitionBy("d").saveAsTable(name)
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_append_aligns_by_name(spark, table):
    shuffled = frame(spark, [(3, "c", "2024-01-03")]).select("d", F.col("k").cast("string").alias("k"), "v")
    sinks.append(shuffled, table)
    assert content(spark, table)[-1] == (3, "c", "2024-01-03") and len(content(spark, table)) == 3


def test_overwrite_partition_leaves_other_days(spark, table):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        with pytest.raises(ValueError):
            sinks.overwrite_partition(frame(spark, [(9, "z", "2024-01-02")]), table, ["d"])
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    sinks.overwrite_partition(frame(spark, [(9, "z", "2024-01-02")]), table, ["d"])
    assert content(spark, table) == [(1, "a", "2024-01-01"), (9, "z", "2024-01-02")]


def test_overwrite_table_may_read_itself(spark, table):
    sinks.overwrite_table(spark.table(table).withColumn("v", F.upper("v")), table)
    assert [r[1] for r in content(spark, table)] == ["A", "B"]
    sinks.overwrite_table(spark.table(table).filter("k = 1"), table)
    assert content(spark, table) == [(1, "A", "2024-01-01")]


def test_upsert_table_twice_gives_the_same(spark, table):
    source = frame(spark, [(2, "new", "2024-01-02"), (3, "c", "2024-01-02")])
    want = [(1, "a", "2024-01-01"), (2, "new", "2024-01-02"), (3, "c", "2024-01-02")]
    for _ in range(2):
        sinks.upsert_table(source, table, ["k"], "d")
        assert content(spark, table) == want


def test_create_from_dataframe_derives_days(spark):
    spark.sql("DROP TABLE IF EXISTS made_t")
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("event_time"))
    parts = sinks.create_from_dataframe(df, "made_t", ["event_time"])
    assert parts == ["event_time_day"] and spark.table("made_t").count() == 0
    sinks.append(sinks.with_day_columns(df, ["event_time"]), "made_t")
    assert str(spark.table("made_t").first().event_time_day) == "2024-01-01"
    assert sinks.create_from_dataframe(df, "made_t", ["event_time"]) == parts and spark.table("made_t").count() == 1
    spark.sql("DROP TABLE made_t")


def test_compact_and_health(spark, folder):
    spark.range(2000).repartition(20).write.parquet(f"{folder}/small")
    before = file_health(spark.read.parquet(f"{folder}/small")).first()
    assert (before.total_files, before.small_files, before.health_score, before.status) == (20, 20, 80, "GOOD")
    assert before.advice == "compact small files"
    assert sinks.compact(spark, f"{folder}/small", f"{folder}/big") == 1
    after = file_health(spark.read.parquet(f"{folder}/big"), small_bytes=10).first()
    assert (after.total_files, after.health_score, after.status) == (1, 100, "EXCELLENT")
    assert spark.read.parquet(f"{folder}/big").count() == 2000


def test_compact_keeps_partitions(spark, folder):
    spark.range(100).withColumn("p", F.col("id") % 3).repartition(10).write.partitionBy("p").parquet(f"{folder}/in")
    sinks.compact(spark, f"{folder}/in", f"{folder}/out", partition_by=["p"])
    out = spark.read.parquet(f"{folder}/out")
    assert out.count() == 100 and out.filter("p = 1").count() == 33


def files(spark, table):
    return set(spark.table(table).inputFiles())


def test_upsert_keeps_rows_without_a_partition(spark, table):
    sinks.append(frame(spark, [(7, "x", None), (8, "y", None)]), table)
    sinks.upsert_table(frame(spark, [(8, "new", None), (9, "z", None)]), table, ["k"], "d")
    assert [r for r in content(spark, table) if r[2] == "None"] == [(7, "x", "None"), (8, "new", "None"), (9, "z", "None")]
    assert len(content(spark, table)) == 5


def test_upsert_reads_and_writes_touched_days_only(spark, table):
    before = {f for f in files(spark, table) if "d=2024-01-01" in f}
    sinks.upsert_table(frame(spark, [(2, "new", "2024-01-02")]), table, ["k"], "d")
    assert before <= files(spark, table)
    days = frame(spark, [(0, "", "2024-01-02")]).select("d")
    text = sinks.in_slices(spark.table(table), "d", days)._jdf.queryExecution().executedPlan().toString()
    part = text[text.index("PartitionFilters"):]
    assert "2024-01-02" in part[: part.index("]")]


def test_replace_slices_drops_days_left_empty(spark, table):
    sinks.append(frame(spark, [(3, "c", "2024-01-03"), (4, "n", None)]), table)
    dates = frame(spark, [(0, "", "2024-01-02"), (0, "", "2024-01-03"), (0, "", None)]).select("d")
    sinks.replace_slices_in_table(frame(spark, [(5, "e", "2024-01-03")]), table, "d", dates)
    assert content(spark, table) == [(1, "a", "2024-01-01"), (5, "e", "2024-01-03")]
    sinks.replace_slices_in_table(frame(spark, []), table, "d", dates.filter("d = '2024-01-03'"))
    assert content(spark, table) == [(1, "a", "2024-01-01")]


def test_written_times_have_statistics(spark, folder):
    spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS t").write.parquet(f"{folder}/t")
    part = next(Path(f"{folder}/t").glob("part-*"))
    stats = pq.ParquetFile(part).metadata.row_group(0).column(0).statistics
    assert stats is not None and stats.has_min_max and stats.min.hour == 10


def test_file_sizes_opens_no_file(spark, folder):
    spark.range(100).repartition(3).write.parquet(f"{folder}/f")
    sizes = sinks.file_sizes(spark.read.parquet(f"{folder}/f"))
    assert "parquet" not in sizes._jdf.queryExecution().executedPlan().toString().lower().split("location")[0]
    assert sizes.count() == 3 and all(r.file_size > 0 for r in sizes.collect())


def test_late_repair_touches_late_days_only(spark, sf):
    w = Workload(spark, sf)
    for t in ("bronze_r", "silver_r"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    bronze = w.bronze_sales.withColumn("event_day", F.to_date("transaction_time"))
    bronze.write.partitionBy("event_day").saveAsTable("bronze_r")
    stored = spark.table("bronze_r")
    made = {"customer": F.col("buyer_id"), "channel": w.channel, "processed": STAMP}
    day = next(
        d for (d,) in stored.select(F.to_date("ingestion_time")).distinct().orderBy(F.to_date("ingestion_time").desc()).collect()
        if late.late_rows(stored, d).limit(1).count()
    )
    old = late.silver_sales(stored.filter(F.to_date("ingestion_time") < F.lit(day)), **made)
    old.write.partitionBy("transaction_date").saveAsTable("silver_r")
    want = late.late_repair(stored, spark.table("silver_r"), day, **made).silver
    want = sorted(map(str, want.select("sale_id", "total_amount", "transaction_date").collect()))
    before = files(spark, "silver_r")
    days = late.repair_table(stored, "silver_r", day, **made)
    assert days and sorted(map(str, spark.table("silver_r").select("sale_id", "total_amount", "transaction_date").collect())) == want
    kept = {f for f in before if not any(f"transaction_date={d}" in f for d in days)}
    assert kept and kept <= files(spark, "silver_r")
    text = late.late_rows(stored, day, partition="event_day")._jdf.queryExecution().executedPlan().toString()
    part = text[text.index("PartitionFilters"):]
    assert str(day) in part[: part.index("]")]
    for t in ("bronze_r", "silver_r"):
        spark.sql(f"DROP TABLE {t}")
