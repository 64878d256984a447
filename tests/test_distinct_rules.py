"""Exact distinct counts: nested key sets are reduced one after the other, rows are not repeated."""

from smeltry.quality import rules as R

COLUMNS = "a string, b int, c int"


def observed(df):
    return {(r["check_name"], r["column_name"]): r["observed"] for r in df.collect()}


def test_nested_and_other_sets(spark):
    rows = [("x", i % 7, i % 3) for i in range(50)] + [(None, None, 1)] * 4 + [("y", None, 2)] * 2
    df = spark.createDataFrame(rows, COLUMNS)
    sets = [("a",), ("a", "b"), ("a", "b", "c"), ("b", "a")]
    others = [("c",), ("b", "c")]
    got = observed(R.run_rules(df, "t", [R.duplicates(s) for s in sets])) | observed(
        R.run_rules(df, "t", [R.duplicates(s) for s in others + sets[:1]] + [R.unique("b")])
    )
    place = {"a": 0, "b": 1, "c": 2}
    for s in sets + others:
        distinct = len({tuple(r[place[k]] for k in s) for r in rows})
        assert got["duplicates", "_".join(s)] == (len(rows) - distinct) / len(rows)
    assert got["uniqueness", "b"] == len(rows) - 8


def test_an_empty_table(spark):
    df = spark.createDataFrame([], COLUMNS)
    got = observed(R.run_rules(df, "t", [*R.key_duplicates(["a", "b"]), R.unique("c")]))
    assert got == {("duplicates", "a_b"): 0.0, ("duplicates", "a"): 0.0, ("uniqueness", "c"): 0.0}


def test_no_row_is_repeated(spark):
    df = spark.createDataFrame([("x", 1, 1)], COLUMNS)
    text = R.run_rules(df, "t", R.key_duplicates(["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and "REBALANCE" in text.rsplit("HashAggregate", 1)[1]
