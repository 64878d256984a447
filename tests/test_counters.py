"""Rule counters by day against whole validations."""

import pytest
from pyspark.sql import functions as F

from smeltry.quality import checks as Q
from smeltry.quality import counters as K
from smeltry.quality import rules as R
from smeltry.workload import Workload

CONFIG = {
    "null_rules": {"customer_id": "critical_fields"}, "non_null_columns": ["event_id", "page_url", "absent"], "key_columns": ["event_id"],
    "range_checks": {"event_time": {"min_date": "2024-01-03", "max_date": "2024-01-25"}}, "pattern_rules": {"customer_id": {"pattern": "^CUST-0", "threshold": 0.5}},
    "business_rules": [{"name": "late", "condition": "ingestion_time < event_time"}, {"name": "broken", "condition": "nothing > 1"}],
    "valid_values": {"event_type": ["view"]},
}
TABLES = ("events_c", "counters_c")


@pytest.fixture()
def stored(spark, sf):
    for t in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    events = Workload(spark, sf).bronze_events.drop("metadata").withColumn("event_day", F.to_date("event_time"))
    odd = events.limit(7).withColumns({"event_day": F.lit(None).cast("date"), "event_time": F.lit(None).cast("timestamp")})
    events.unionByName(odd).write.partitionBy("event_day").saveAsTable("events_c")
    yield spark.table("events_c")
    for t in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def rules(df):
    return R.rules_from_config(CONFIG, df.columns)


def rows(df):
    return sorted(map(str, df.collect()))


def days_of(df):
    return df.select(F.col("event_day").alias("day")).distinct()


def test_counters_equal_a_whole_run(spark, stored):
    want = rows(Q.validate_table(stored, "events", CONFIG))
    assert any("ERROR" in r for r in want) and any("FAIL" in r for r in want)
    counters = K.rule_counters(stored, "events", rules(stored), F.col("event_day"))
    assert rows(K.validate_from_counters(counters, stored, "events", CONFIG)) == want
    none = counters.limit(0)
    assert rows(K.validate_from_counters(none, stored, "events", CONFIG)) != want
    empty = stored.limit(0)
    assert rows(K.validate_from_counters(K.rule_counters(empty, "events", rules(empty), F.col("event_day")), empty, "events", CONFIG)) == rows(Q.validate_table(empty, "events", CONFIG))


def test_a_run_counts_new_and_changed_days_only(spark, stored):
    own = rules(stored)
    K.refresh_counters(stored, "counters_c", "events", own, "event_day", days_of(stored.filter("event_day < '2024-01-20'")))
    counters = spark.table("counters_c")
    missing = K.uncounted_days(counters, days_of(stored), stored, "events", own)
    assert {str(r.day) for r in missing.collect()} == {str(r.day) for r in days_of(stored.filter("event_day >= '2024-01-20' OR event_day IS NULL")).collect()}
    before = set(counters.inputFiles())
    K.refresh_counters(stored, "counters_c", "events", own, "event_day", missing)
    spark.catalog.refreshTable("counters_c")
    assert before < set(spark.table("counters_c").inputFiles())
    assert rows(K.validate_from_counters(spark.table("counters_c"), stored, "events", CONFIG)) == rows(Q.validate_table(stored, "events", CONFIG))
    # a changed day, one that has become empty, and a replay
    stored.filter("event_day = '2024-01-21'").limit(3).withColumn("customer_id", F.lit(None).cast("string")).select(*stored.columns).write.mode("append").insertInto("events_c")
    spark.sql("ALTER TABLE events_c DROP PARTITION (event_day = '2024-01-05')")
    spark.catalog.refreshTable("events_c")
    now = spark.table("events_c")
    for _ in range(2):
        K.refresh_counters(now, "counters_c", "events", own, "event_day", spark.sql("SELECT date'2024-01-21' AS day UNION SELECT date'2024-01-05'"))
        assert rows(K.validate_from_counters(spark.table("counters_c"), now, "events", CONFIG)) == rows(Q.validate_table(now, "events", CONFIG))


def test_untouched_days_are_not_read(spark, stored):
    from smeltry.sources.sinks import in_slices

    some = spark.sql("SELECT date'2024-01-21' AS event_day")
    text = K.rule_counters(in_slices(stored, "event_day", some), "events", rules(stored), F.col("event_day"))._jdf.queryExecution().executedPlan().toString()
    part = text[text.index("PartitionFilters"):]
    assert "2024-01-21" in part[: part.index("]")]


def test_a_changed_rule_has_no_counters(spark, stored):
    counters = K.rule_counters(stored, "events", rules(stored), F.col("event_day"))
    assert K.uncounted_days(counters, days_of(stored), stored, "events", rules(stored)).count() == 0
    other = CONFIG | {"valid_values": {"event_type": ["view", "click"]}}
    new = R.rules_from_config(other, stored.columns)
    assert K.uncounted_days(counters, days_of(stored), stored, "events", new).count() == days_of(stored).count()
    # a new limit needs no new count
    loose = CONFIG | {"pattern_rules": {"customer_id": {"pattern": "^CUST-0", "threshold": 0.9}}}
    assert K.uncounted_days(counters, days_of(stored), stored, "events", R.rules_from_config(loose, stored.columns)).count() == 0
