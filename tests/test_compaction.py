"""Bin packing of small files in place."""

import json
import random

import pytest
from pyspark.sql import functions as F

from smeltry.sources import compaction as C


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("id", "p").collect()))


@pytest.fixture()
def small(spark, folder):
    """Two large files and forty small ones, of a column with no pattern to compress."""
    made = lambda a, b: spark.range(a, b).select("id", F.sha2(F.col("id").cast("string"), 256).alias("p"))
    made(0, 40_000).coalesce(1).sortWithinPartitions("id").write.parquet(f"{folder}/t")
    made(40_000, 80_000).coalesce(1).write.mode("append").parquet(f"{folder}/t")
    for k in range(4):
        made(80_000 + k * 4000, 84_000 + k * 4000).repartition(10).write.mode("append").parquet(f"{folder}/t")
    return f"{folder}/t"


def test_large_files_stay_and_small_ones_end_near_the_target(spark, small):
    before, want = dict(C.data_files(spark, small)), rows(spark, small)
    large = {k for k, v in before.items() if v > 500_000}
    target = 300_000
    assert len(large) == 2 and len(before) == 42
    n = C.bin_pack(spark, small, target, min_input_files=3)
    after = dict(C.data_files(spark, small))
    assert large <= after.keys() and {k: after[k] for k in large} == {k: before[k] for k in large}
    new = [v for k, v in after.items() if k not in before]
    assert n == len(new) == len(after) - 2 and max(new) <= 1.1 * target and sorted(new)[1] >= 0.8 * target
    assert rows(spark, small) == want
    assert C.bin_pack(spark, small, target, min_input_files=3) == 0 and dict(C.data_files(spark, small)) == after


def test_no_shuffle_and_a_task_for_each_bin(spark, small):
    bins = C.plan_bins(C.data_files(spark, small), 300_000)
    for b in bins:
        df = C.merged(spark, b.files, C.data_schema(spark, small))
        assert "Exchange" not in plan_of(df) and df.rdd.getNumPartitions() == 1
    assert len(bins) > 3
    assert all(b.size <= 300_000 for b in bins) and sum(len(b.files) for b in bins) == 40


def test_rows_of_a_file_keep_their_order(spark, folder):
    for k in range(3):
        spark.range(k * 100, k * 100 + 100).coalesce(1).sortWithinPartitions(F.desc("id")).write.mode("append").parquet(f"{folder}/o")
    assert C.bin_pack(spark, f"{folder}/o", 1 << 20) == 1
    ids = [r.id for r in spark.read.parquet(f"{folder}/o").collect()]
    assert all(b == a - 1 for a, b in zip(ids, ids[1:]) if a % 100) and sorted(ids) == list(range(300))


def test_partitions_are_packed_apart_and_columns_may_come_later(spark, folder):
    path = f"{folder}/p"
    spark.range(90).withColumn("p", (F.col("id") % 3).cast("int")).repartition(6).write.partitionBy("p").parquet(path)
    spark.range(90, 96).select("id", (F.col("id") % 3).cast("int").alias("p"), F.lit("new").alias("late")).coalesce(1).write.mode("append").partitionBy("p").parquet(path)
    want = sorted(map(str, spark.read.option("mergeSchema", "true").parquet(path).select("id", "p", "late").collect()))
    assert C.bin_pack(spark, path, 1 << 20) == 3
    files = C.data_files(spark, path)
    assert len(files) == 3 and {n.rsplit("/", 2)[1] for n, _ in files} == {"p=0", "p=1", "p=2"}
    assert sorted(map(str, spark.read.parquet(path).select("id", "p", "late").collect())) == want


def test_an_interrupted_run_is_finished_or_undone(spark, small, monkeypatch):
    want, before = rows(spark, small), C.data_files(spark, small)

    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(C, "_write", stopped)
        with pytest.raises(RuntimeError):
            C.bin_pack(spark, small, 300_000)
    assert C.data_files(spark, small) == before and rows(spark, small) == want
    done = C.finish
    with monkeypatch.context() as m:
        m.setattr(C, "finish", lambda *_: None)
        C.bin_pack(spark, small, 300_000)
    assert C.data_files(spark, small) == before and rows(spark, small) == want
    # half of the journal's renames are done, then the run dies
    fs, root = C._fs(spark, small)
    staged = next(s.getPath().toString() for s in fs.listStatus(root) if s.getPath().getName().startswith(C.STAGING) and C._read(spark, f"{s.getPath().toString()}/{C.JOURNAL}"))
    moves = json.loads(C._read(spark, f"{staged}/{C.JOURNAL}"))["moves"]
    fs.rename(C._fs(spark, moves[0][0])[1], C._fs(spark, moves[0][1])[1])
    done(spark, small)
    assert rows(spark, small) == want and len(C.data_files(spark, small)) < len(before)
    assert not [s for s in fs.listStatus(root) if s.getPath().getName().startswith(C.STAGING)]


def test_first_fit():
    rnd = random.Random(1)
    sizes = [(f"d/{k:04}", rnd.randint(1, 60)) for k in range(500)]
    bins = C.first_fit(sizes, 100)
    assert sorted(f for b in bins for f in b.files) == [n for n, _ in sizes] and all(b.size <= 100 for b in bins)
    assert len(bins) <= 1.2 * sum(s for _, s in sizes) / 100
    assert C.first_fit([], 10) == [] and [b.files for b in C.first_fit([("d/a", 6), ("d/b", 7), ("d/c", 4)], 10)] == [["d/a", "d/c"], ["d/b"]]
