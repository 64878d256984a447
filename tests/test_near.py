"""Keys are brought together before a task holds them: its memory follows AQE's advisory size."""

from pyspark.sql import functions as F

from smeltry.operators import joins as J
from smeltry.operators import keys as K
from smeltry.plans import late


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark):
    """A hot key, one without a value and many that occur once."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 == 0, None).otherwise(F.concat(F.lit("k"), "id"))
    return spark.range(20_000).select(key.alias("key"), "id")


def under(text, operator):
    """What the lowest such operator of a plan reads."""
    return text.rsplit(operator, 1)[1]


def test_near_keeps_every_row(spark):
    df = rows(spark)
    assert K.near(df, ["key"]).columns == df.columns
    assert K.near(df, ["key"]).exceptAll(df).count() == 0 and K.near(df, ["key"]).count() == 20_000


def test_latest_per_key_limits_groups_behind_a_shuffle(spark):
    got = K.latest_per_key(rows(spark), ["key"], [F.col("id").desc()])
    assert "REBALANCE" in under(plan(got), "WindowGroupLimit")
    want = rows(spark).groupBy("key").agg(F.max("id").alias("id"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_key_presence_combines_behind_a_shuffle(spark):
    left, right = rows(spark), rows(spark).filter("id % 2 = 0").withColumnRenamed("key", "other")
    both = late.key_presence(left, "key", right, "other")
    assert "REBALANCE" in under(plan(both), "HashAggregate")
    got = {r["key"]: (r["in_left"], r["in_right"]) for r in both.collect()}
    a = {r[0] for r in left.select("key").collect()} - {None}
    b = {r[0] for r in right.select("other").collect()} - {None}
    assert got == {k: (k in a, k in b) for k in a | b}


def test_without_aqe_nothing_is_shuffled_before(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = K.latest_per_key(rows(spark), ["key"], [F.col("id").desc()])
        assert "REBALANCE" not in plan(got) and got.filter("key = 'hot'").first()["id"] == 19_998
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_salted_join_tells_neither_side_of_hot_keys_by_a_join(spark):
    left = rows(spark).withColumn("v", F.col("id") * 2)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "name string, w int")
    got = J.salted_join(left, right, "key", "name", "left", 4)
    main = plan(got).split("Subquery")[0]
    assert main.count("Join") == 1
    want = left.join(right, F.col("key") == F.col("name"), "left")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
