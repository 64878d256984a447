"""Streams drained in several micro-batches equal their batch twins."""

import glob
import os

from pathlib import Path

from pyspark.sql import functions as F

from smeltry import schemas as S
from smeltry.functions.ladders import MONITOR_DELAY
from smeltry.operators import rows as R
from smeltry.sources.envelope import parse_user_events
from smeltry.sources.files import read_events_stream
from smeltry.streaming import events as E
from smeltry.streaming import jobs
from smeltry.workload import Workload


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name), q


def rows(df):
    return sorted(map(str, df.collect()))


def file_stream(df, folder, parts, order):
    """The frame as files in time order, read back one file per micro-batch."""
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(folder)
    for age, file in enumerate(sorted(glob.glob(f"{folder}/part-*"))):
        os.utime(file, (1_700_000_000 + age, 1_700_000_000 + age))
    spark = df.sparkSession
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_bronze_stream_equals_batch(spark, sf, folder):
    envelope = Workload(spark, sf).event_envelope
    envelope.repartition(3).write.parquet(f"{folder}/in")
    stream = read_events_stream(spark, f"{folder}/in", files_per_trigger=1)
    q = jobs.bronze_stream(stream, "user_activity_events", f"{folder}/out", f"{folder}/cp", every=None)
    q.awaitTermination()
    assert len(q.recentProgress) >= 3
    got = spark.read.parquet(f"{folder}/out")
    want = parse_user_events(envelope)
    cols = [c for c in S.RAW_USER_EVENTS.fieldNames() if c != "metadata"]
    assert rows(got.select(*cols)) == rows(want.select(*cols))
    assert got.filter("event_day <> to_date(event_time)").count() == 0


def test_sales_parser_on_stream(spark, sf, folder):
    w = Workload(spark, sf)
    w.sales_envelope.repartition(2).write.parquet(f"{folder}/in")
    stream = read_events_stream(spark, f"{folder}/in", files_per_trigger=1)
    got, _ = drain(jobs.bronze_rows(stream, "marketplace_sales").drop("marketplace_metadata"), "sales_out")
    assert got.count() == w.bronze_sales.filter("product_id IS NOT NULL").count()


def test_dedupe_stream_across_batches(spark, folder):
    data = [(i % 50, f"2024-01-01 {i // 50:02d}:00:00") for i in range(200)]
    df = spark.createDataFrame(data, "k int, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    out, q = drain(E.dedupe_stream(file_stream(df, f"{folder}/in", 4, "t"), ["k"], "t"), "dedupe_out")
    assert len(q.recentProgress) >= 2 and out.count() == 50 and out.select("k").distinct().count() == 50


def test_watermark_accepts_zoneless_time_and_drops_too_late_events(spark, folder):
    schema = "t timestamp_ntz, k string"
    path = f"{folder}/in"
    batches = [
        [("2024-01-10 00:00:00", "a")], [("2024-01-20 00:00:00", "b")],
        [("2024-01-19 00:00:00", "within"), ("2024-01-01 00:00:00", "beyond")], [("2024-01-30 00:00:00", "end")],
    ]
    for b in batches:
        spark.createDataFrame(b, "t string, k string").select(F.col("t").cast("timestamp_ntz").alias("t"), "k").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    counted = E.watermark(stream, "t", "48 hours").groupBy(F.window("t", "1 day"), "k").count()
    out, _ = drain(counted, "late_out")
    kinds = {r.k for r in out.collect()}
    assert "within" in kinds and "beyond" not in kinds


def test_delay_histogram_stream_equals_batch(spark, sf, folder):
    e = Workload(spark, sf).bronze_events.select("event_time", "ingestion_time").withColumn("topic", F.lit("t"))
    tail = e.orderBy(F.desc("ingestion_time")).limit(1).withColumn("ingestion_time", F.col("ingestion_time") + F.expr("interval 30 days"))
    fed = e.unionByName(tail)
    stream = file_stream(fed, f"{folder}/in", 5, "ingestion_time")
    args = ("event_time", "ingestion_time", MONITOR_DELAY)
    out, q = drain(E.delay_histogram(stream, *args), "hist_out")
    batch = E.delay_histogram(e, *args)
    assert len(q.recentProgress) >= 3
    assert rows(out) == rows(batch)
    assert batch.agg(F.sum("messages")).first()[0] == e.count()


def test_session_stream_equals_batch(spark, sf, folder):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    last = e.agg((F.max("t") + F.expr("interval 60 days")).alias("t")).select(F.lit(-1).cast("bigint").alias("user_id"), "t")
    stream = file_stream(e.unionByName(last), f"{folder}/in", 4, "t")
    out, _ = drain(E.session_activity_stream(stream, "user_id", "t"), "session_out")
    batch = E.session_activity(e, "user_id", "t").drop("session_no")
    assert rows(out) == rows(batch)


def test_alerts_are_stateless(spark, sf, folder):
    from smeltry.operators import rows as R

    e = Workload(spark, sf).bronze_events.select("event_id", "event_time", "ingestion_time")
    stream = file_stream(e, f"{folder}/in", 3, "ingestion_time")

    def alerts(df):
        return E.high_delay_alerts(R.with_delay(df, "event_time", "ingestion_time", MONITOR_DELAY))

    out, _ = drain(alerts(stream), "alert_out")
    assert rows(out) == rows(alerts(e))


def test_stream_upsert(spark, folder):
    spark.sql("DROP TABLE IF EXISTS live_t")
    spark.createDataFrame([(1, "old", 0, "d1"), (9, "kept", 0, "d9")], "k int, v string, n int, d string").write.partitionBy("d").saveAsTable("live_t")
    path = f"{folder}/in"
    for b in ([(1, "x", 1, "d1"), (2, "y", 1, "d1")], [(1, "z", 2, "d1"), (1, "w", 3, "d1"), (3, "q", 1, "d2")]):
        spark.createDataFrame(b, "k int, v string, n int, d string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k int, v string, n int, d string").option("maxFilesPerTrigger", 1).parquet(path)
    jobs.stream_upsert(stream, "live_t", ["k"], "d", f"{folder}/cp", [F.desc("n")]).awaitTermination()
    got = sorted((r.k, r.v) for r in spark.table("live_t").collect())
    assert got == [(1, "w"), (2, "y"), (3, "q"), (9, "kept")]
    spark.sql("DROP TABLE live_t")


def test_metrics(spark, folder):
    df, handle = jobs.observed(spark.range(100), "rows_seen", F.max("id").alias("top"))
    df.write.parquet(f"{folder}/out")
    assert handle.get == {"records_processed": 100, "top": 99}
    assert jobs.processing_metrics(10, 0.0)["records_per_second"] == 0.0

    listener = jobs.ProgressListener(keep=2)
    spark.streams.addListener(listener)
    try:
        spark.range(30).repartition(3).write.parquet(f"{folder}/in")
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        _, q = drain(stream, "metric_out")
        import time

        for _ in range(50):
            if listener.batches.get(str(q.id)):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    seen = listener.batches[str(q.id)]
    assert 1 <= len(seen) <= 2 and all(b["records_processed"] >= 0 for b in seen)


def test_delay_report_of_micro_batches_equals_batch(spark, sf, folder):
    df = Workload(spark, sf).bronze_sales.select("transaction_id", "product_id", "transaction_time", "ingestion_time", F.lit("sales").alias("topic"))
    order = ["-ingestion_time", "transaction_id", "product_id", "transaction_time"]
    batch_order = [F.col("ingestion_time").desc(), F.col("transaction_id"), F.col("product_id"), F.col("transaction_time")]
    file_stream(df, f"{folder}/all", 4, "ingestion_time")
    files = sorted(Path(f"{folder}/all").glob("part-*"))
    Path(f"{folder}/in").mkdir()
    seen = []

    def run(n):  # the next n files, from the same checkpoint
        for f in files[:n]:
            f.rename(f"{folder}/in/{f.name}")
        del files[:n]
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        report = lambda totals, recent, n: seen.append((n, rows(totals), list(map(str, recent.collect()))))
        q = jobs.delay_report_stream(stream, report, f"{folder}/cp", "transaction_time", "ingestion_time", order)
        q.awaitTermination()
        read = spark.read.schema(df.schema).parquet(f"{folder}/in")
        delayed = R.with_delay(read, "transaction_time", "ingestion_time", MONITOR_DELAY)
        totals = E.delay_totals(delayed.groupBy("topic", "delay_category").agg(F.count(F.lit(1)).alias("messages")))
        assert seen[-1][1] == rows(totals)
        assert seen[-1][2] == list(map(str, E.recent_high_delays(delayed, batch_order).collect()))

    run(2)
    assert [n for n, *_ in seen] == [0, 1]
    run(len(files))  # a restart goes on from the state store
    assert [n for n, *_ in seen] == list(range(len(seen))) and len(seen) >= 3


def test_delay_report_keeps_nulls_and_ties_in_order(spark, folder):
    data = [("a", "2024-01-02 00:00:00", 1), ("a", None, 2), (None, "2024-01-02 00:00:00", 3), ("b", "2024-01-03 00:00:00", None)]
    df = spark.createDataFrame([(t, i, n, "2024-01-01 00:00:00") for t, i, n in data * 30], "topic string, i string, n int, e string")
    df = df.select("topic", F.col("i").cast("timestamp").alias("i"), "n", F.col("e").cast("timestamp").alias("e"))
    df.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    seen = []
    report = lambda totals, recent, _: seen.append((rows(totals), rows(recent)))
    jobs.delay_report_stream(stream, report, f"{folder}/cp", "e", "i", ["-i", "n", "topic"], last=40, show=40).awaitTermination()
    delayed = R.with_delay(df, "e", "i", MONITOR_DELAY)
    counts = delayed.groupBy("topic", "delay_category").agg(F.count(F.lit(1)).alias("messages"))
    recent = E.recent_high_delays(delayed, [F.col("i").desc(), F.col("n"), F.col("topic")], last=40, show=40)
    assert seen[-1] == (rows(E.delay_totals(counts)), rows(recent)) and len(seen[-1][1]) == 40
