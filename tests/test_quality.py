"""Rules, expectations and roll-ups on small tables."""

import pytest
from pyspark.sql import functions as F

from smeltry.quality import checks as Q
from smeltry.quality import expectations as X
from smeltry.quality import rollup as U
from smeltry.quality import rules as R


@pytest.fixture(scope="module")
def dq(spark):
    """100 rows: NULL shares of 0, 4, 5 and 6 %, one duplicated id, odd values."""
    rows = [
        (1 if i == 99 else i, None if i < 4 else "x", None if i < 5 else "x", None if i < 6 else "x",
         -1 if i == 0 else i, "bad" if i < 10 else "a@b.c")
        for i in range(100)
    ]
    return spark.createDataFrame(rows, "id int, n4 string, n5 string, n6 string, num int, mail string")


def statuses(df):
    return {(r.column_name, r.metric): r.status for r in df.collect()}


def test_null_levels(dq):
    rules = [R.null_limit(c, lvl) for c in ("n4", "n5", "n6") for lvl in ("important_fields",)]
    assert list(statuses(R.run_rules(dq, "t", rules)).values()) == ["PASS", "PASS", "WARN"]
    crit = R.run_rules(dq, "t", [R.null_limit("n4", "critical_fields"), R.null_limit("id", "critical_fields")])
    assert statuses(crit) == {("n4", "null_percentage"): "FAIL", ("id", "null_percentage"): "PASS"}


def test_completeness_and_empty_slice(dq):
    got = statuses(R.run_rules(dq, "t", [R.completeness(c) for c in ("id", "n5", "n6")]))
    assert list(got.values()) == ["PASS", "WARN", "FAIL"]
    assert statuses(R.run_rules(dq.filter("false"), "t", [R.completeness("id")])) == {("id", "null_percentage"): "WARN"}


def test_distinct_rules_count_null_once(dq):
    got = {r.column_name: r.observed for r in R.run_rules(dq, "t", [R.unique("id"), R.unique("n4")]).collect()}
    assert got == {"id": 1.0, "n4": 98.0}
    assert statuses(R.run_rules(dq, "t", R.key_duplicates(["id", "num"]))) == {
        ("id_num", "duplicate_percentage"): "PASS", ("id", "duplicate_percentage"): "PASS"}


def test_ranges_patterns_rules_sets(dq):
    rules = R.value_range("num", 0, 99) + [
        R.pattern("mail", kind="email"), R.pattern("mail", kind="email", limit=0.1),
        R.business_rule("r", "n4 = 'y'", "CRITICAL"), R.business_rule("s", "num < 1000"),
        R.allowed_values("n4", ["x"]), R.allowed_values("mail", ["bad"]), R.unique("absent"),
    ]
    got = [(r.check_name, r.column_name, r.status, r.observed) for r in R.run_rules(dq, "t", rules).collect()]
    assert got == [
        ("range", "num", "FAIL", 1.0), ("range", "num", "PASS", 0.0),
        ("pattern", "mail", "FAIL", 0.1), ("pattern", "mail", "PASS", 0.1),
        ("business_rule", "r", "FAIL", 96.0), ("business_rule", "s", "PASS", 0.0),
        ("allowed_values", "n4", "PASS", 0.0), ("allowed_values", "mail", "FAIL", 90.0),
        ("uniqueness", "absent", "ERROR", None),
    ]


def test_schema_check(dq):
    got = [(r.column_name, r.metric, r.status) for r in Q.schema_check(
        dq, "t", ["id", "n4", "n5", "n6", "num", "gone"], {"id": "int", "num": "bigint"}).collect()]
    assert ("gone", "present", "FAIL") in got and ("num", "type_matches", "FAIL") in got
    assert ("mail", "extra_column", "PASS") in got and ("id", "type_matches", "PASS") in got


def expect(df, kind, **kwargs):
    s = X.load_suite({"expectation_suite_name": "s", "expectations": [{"expectation_type": kind, "kwargs": kwargs}]})
    r = X.run_suite(df, s).first()
    return r.success, r.unexpected_count


@pytest.mark.parametrize(
    "kind,good,bad,count",
    [
        ("expect_column_values_to_not_be_null", {"column": "a"}, {"column": "c"}, 1),
        ("expect_column_values_to_be_unique", {"column": "a"}, {"column": "b"}, 1),
        ("expect_column_values_to_be_in_set", {"column": "a", "value_set": [1, 2, 3]}, {"column": "c", "value_set": [2]}, 2),
        ("expect_column_values_to_be_between", {"column": "a", "min_value": 1, "max_value": 3}, {"column": "a", "min_value": 2}, 1),
        ("expect_column_values_to_be_between", {"column": "t", "min_value": "2024-01-01T00:00:00"}, {"column": "t", "max_value": "2024-01-01T00:00:00"}, 3),
        ("expect_column_values_to_match_regex", {"column": "s", "regex": "^x"}, {"column": "s", "regex": "^x1"}, 2),
        ("expect_column_pair_values_to_be_equal", {"column_A": "a", "column_B": "a"}, {"column_A": "a", "column_B": "c"}, 1),
        ("expect_column_pair_values_A_to_be_greater_than_or_equal_to_B", {"column_A": "a", "column_B": "b"}, {"column_A": "b", "column_B": "a"}, 2),
        ("expect_column_pair_values_A_to_be_greater_than_B", {"column_A": "a", "column_B": "z"}, {"column_A": "a", "column_B": "b"}, 1),
    ],
)
def test_expectations(spark, kind, good, bad, count):
    df = spark.createDataFrame([(1, 1, 1, 0, "x1"), (2, 1, 3, 0, "x2"), (3, 2, None, 0, "x3")], "a int, b int, c int, z int, s string")
    df = df.withColumn("t", F.lit("2024-06-01").cast("timestamp"))
    assert expect(df, kind, **good) == (True, 0)
    assert expect(df, kind, **bad) == (False, count)
    absent = {k: ("absent" if k.startswith("column") else v) for k, v in good.items()}
    assert expect(df, kind, **absent) == (False, None)


def test_table_expectations_and_partition(spark):
    df = spark.createDataFrame([(1, "d1"), (2, "d1"), (3, "d2")], "a int, d string")
    assert expect(df, "expect_table_columns_to_match_ordered_list", column_list=["a", "d"])[0]
    assert not expect(df, "expect_table_columns_to_match_ordered_list", column_list=["d", "a"])[0]
    assert expect(df, "expect_table_row_count_to_be_between", min_value=3, max_value=3)[0]
    assert not expect(df, "expect_table_row_count_to_be_between", min_value=4)[0]
    s = X.load_suite('{"expectation_suite_name": "s", "expectations": [{"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 2, "max_value": 2}}]}')
    assert X.run_suite(df, s, {"d": "d1"}).first().success and not X.run_suite(df, s).first().success


def suite_rows(spark, outcomes):
    rows = [(t, i, ok) for t, oks in outcomes.items() for i, ok in enumerate(oks)]
    return spark.createDataFrame(rows, "table_name string, position int, success boolean")


def test_expectation_levels(spark):
    df = suite_rows(spark, {"all": [True] * 5, "most": [True] * 4 + [False], "few": [True] * 3 + [False] * 2})
    got = {r.table_name: (r.status, r.success_percent) for r in U.expectation_status(df).collect()}
    assert got == {"all": ("PASSED", 100.0), "most": ("WARNING", 80.0), "few": ("FAILED", 60.0)}


def test_hybrid_alerts_and_summary(spark):
    suites = suite_rows(spark, {"a": [True] * 5, "b": [True] * 4 + [False]})
    rules = spark.createDataFrame([("a", "PASS"), ("a", "ERROR"), ("b", "PASS")], "table_name string, status string")
    tables = U.hybrid_status(rules, suites)
    assert {r.table_name: (r.status, r.total, r.passed) for r in tables.collect()} == {"a": ("ERROR", 7, 6), "b": ("WARNING", 6, 5)}
    layer = U.hybrid_layer_status(tables)
    assert layer.first().status == "FAILED"
    assert sorted(r.severity for r in U.alerts(layer, "silver").collect()) == ["CRITICAL", "WARNING"]
    clean = U.hybrid_layer_status(tables.filter("table_name = 'b'").withColumn("success_percent", F.lit(83.3)))
    assert [r.severity for r in U.alerts(clean, "silver").collect()] == ["WARNING"]

    def overall(*states):
        df = spark.createDataFrame([(s, 1, 1, 0, 1, 1, 0) for s in states],
                                   "status string, tables int, tables_passed int, tables_failed int, total int, passed int, failed int")
        return U.run_summary(df).first().status

    assert overall("PASSED", "WARNING") == "PASSED"
    assert overall("PASSED", "WARNING", "FAILED") == "WARNING"
    assert overall("PASSED", "FAILED") == "FAILED"


def test_layer_status_caps_error_as_fail(spark):
    df = spark.createDataFrame([("a", "PASS"), ("b", "ERROR")], "table_name string, status string")
    r = U.layer_status(df, "gold").first()
    assert (r.status, r.tables, r.failed) == ("FAIL", 2, 1)


def test_freshness_of_nothing_fails(spark):
    df = spark.createDataFrame([], "t timestamp")
    assert Q.freshness(df, "t", "t", "2024-01-01 00:00:00", 24).first().status == "FAIL"


def test_unresolvable_rule_does_not_stop_the_others(dq):
    rules = [R.business_rule("broken", "no_such_column > 0"), R.business_rule("syntax", "num >"), R.business_rule("fine", "num >= 0")]
    got = {r.column_name: r.status for r in R.run_rules(dq, "t", rules).collect()}
    assert got == {"broken": "ERROR", "syntax": "ERROR", "fine": "WARN"}


def test_null_rules_cover_unnamed_columns(dq):
    out = Q.validate_table(dq, "t", {"null_rules": {"n5": "critical_fields"}})
    got = {r.column_name: r.status for r in out.collect()}
    assert set(got) == set(dq.columns) and got["n5"] == "FAIL" and got["n6"] == "PASS"
