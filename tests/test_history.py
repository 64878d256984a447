"""Type-2 history on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from smeltry.operators import history as H
from smeltry.operators import joins as J
from smeltry.quality import checks

DIM = (
    "customer_sk bigint, customer_id string, name string, email string, effective_start_date date, "
    "effective_end_date date, is_current boolean, created_time timestamp, updated_time timestamp"
)
SNAP = "customer_id string, name string, email string, last_updated string"
OPEN = date(9999, 12, 31)
D0, D1, D2 = date(2024, 1, 1), date(2024, 1, 10), date(2024, 1, 20)


@pytest.fixture(scope="module")
def dim(spark):
    rows = [
        (1, "same", "a", "a@x", D0, OPEN, True, None, None),
        (2, "changed", "b", "b@x", D0, OPEN, True, None, None),
        (3, "filled", "c", None, D0, OPEN, True, None, None),
        (4, "emptied", "d", "d@x", D0, OPEN, True, None, None),
        (5, "absent", "e", "e@x", D0, OPEN, True, None, None),
        (6, "returning", "f", "f@x", date(2023, 1, 1), D0, False, None, None),
    ]
    return spark.createDataFrame(rows, DIM)


@pytest.fixture(scope="module")
def snapshot(spark):
    return spark.createDataFrame(
        [
            ("same", "a", "a@x", "08"), ("changed", "b1", "b@x", "08"), ("changed", "b2", "b@x", "12"),
            ("filled", "c", "c@x", "08"), ("emptied", "d", None, "08"), ("new", "n", "n@x", "08"),
            ("returning", "f", "f@x", "08"), (None, "z", "z@x", "08"),
        ],
        SNAP,
    )


def run(dim, snapshot, day):
    return H.scd2_apply(
        dim, snapshot, "customer_id", ["name", "email"], day, order=[F.desc("last_updated")],
        stamp="2024-01-10 00:00:00",
    )


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.customer_id, []).append(r)
    return {k: sorted(v, key=lambda r: (r.effective_start_date, r.customer_sk)) for k, v in out.items()}


def test_versions(dim, snapshot):
    got = by_id(run(dim, snapshot, D1))
    assert {k: len(v) for k, v in got.items()} == {
        "same": 1, "changed": 2, "filled": 2, "emptied": 2, "absent": 1, "returning": 2, "new": 1,
    }
    old, new = got["changed"]
    assert (old.effective_end_date, old.is_current) == (D1, False)
    assert (new.name, new.effective_start_date, new.effective_end_date, new.is_current) == ("b2", D1, OPEN, True)
    assert got["filled"][1].email == "c@x" and got["emptied"][1].email is None
    assert got["absent"][0].is_current
    assert [r.is_current for r in got["returning"]] == [False, True]
    assert got["returning"][0].effective_end_date == D0


def test_invariants(dim, snapshot):
    out = run(dim, snapshot, D1)
    rows = out.collect()
    assert len({r.customer_sk for r in rows}) == len(rows)
    assert min(r.customer_sk for r in rows if r.effective_start_date == D1) > 6
    current = [r.customer_id for r in rows if r.is_current]
    assert len(current) == len(set(current))
    status = {r.metric: r.observed for r in checks.scd_integrity(out, "d").collect()}
    assert status["multiple_current"] == status["start_after_end"] == status["overlapping_versions"] == 0


def test_rerun_changes_nothing(dim, snapshot):
    once = run(dim, snapshot, D1)
    again = run(once, snapshot, D1)
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_second_day_keeps_all_history(spark, dim, snapshot):
    later = spark.createDataFrame([("changed", "b3", "b@x", "08")], SNAP)
    got = by_id(run(run(dim, snapshot, D1), later, D2))["changed"]
    assert [r.name for r in got] == ["b", "b2", "b3"]
    assert [(r.effective_start_date, r.effective_end_date) for r in got] == [(D0, D1), (D1, D2), (D2, OPEN)]


def test_as_of_is_half_open(dim, snapshot):
    out = run(dim, snapshot, D1)
    assert [r.name for r in H.as_of(out, date(2024, 1, 9)).filter("customer_id = 'changed'").collect()] == ["b"]
    assert [r.name for r in H.as_of(out, D1).filter("customer_id = 'changed'").collect()] == ["b2"]


def test_breaks_across_months(spark):
    rows = [
        (1, "k", date(2024, 1, 1), date(2024, 1, 15)), (2, "k", date(2024, 1, 10), date(2024, 2, 5)),
        (3, "k", date(2024, 2, 20), date(2024, 4, 1)), (4, "k", date(2024, 3, 1), OPEN),
        (5, "q", date(2024, 1, 1), date(2024, 3, 1)), (6, "q", date(2024, 3, 1), OPEN),
    ]
    df = spark.createDataFrame(rows, "sk bigint, id string, effective_start_date date, effective_end_date date")
    r = H.interval_breaks(df, "id", "sk").first()
    assert (r.overlaps, r.gaps) == (2, 1)


def test_interval_join_of_ten_thousand_versions(spark):
    """One key holds 10,000 versions of a day each and most facts; others have gaps, overlaps and open ends."""
    from datetime import timedelta

    start = date(1990, 1, 1)
    at = lambda n: start + timedelta(days=n)
    versions = [("hot", at(n), at(n + 1), n) for n in range(10_000)] + [("hot", at(10_000), OPEN, 10_000), ("hot", at(5), at(5), -1)]
    versions += [("gap", at(0), at(40), 1), ("gap", at(95), None, 2), ("both", at(0), at(400), 1), ("both", at(30), OPEN, 2), ("late", at(3), OPEN, 7)]
    dim = spark.createDataFrame(versions, "k string, effective_start_date date, effective_end_date date, sk int").withColumn("is_current", F.lit(True))
    facts = [("hot", n * 7 % 10_500) for n in range(3000)] + [(k, n) for k in ("gap", "both", "late", "none", None) for n in range(-40, 450, 9)]
    df = spark.createDataFrame([(i, k, None if i % 101 == 5 else at(n)) for i, (k, n) in enumerate(facts)], "i int, k string, t date")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    got = J.temporal_join(df, dim, "k", "t", ["sk"], history=True)
    want = []
    for r in df.collect():
        day = r.t and r.t.date()
        hits = [sk for k, a, b, sk in versions if k == r.k and day and a <= day < (b or OPEN)]
        want += [(r.i, sk) for sk in hits or [None]]
    assert sorted(map(str, got.select("i", "sk").collect())) == sorted(f"Row(i={i}, sk={sk})" for i, sk in want) and got.columns == ["i", "k", "t", "sk"]
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "_month" in text and "NestedLoop" not in text
    bins = next(x for x in text.split("\n") if "Join [" in x and "_month" in x)
    assert "_from" not in bins  # the range is no residual of the join


def test_history_table_rewrites_the_current_part_only(spark, dim, snapshot):
    from smeltry.sources import history_table as T

    spark.sql("DROP TABLE IF EXISTS hist_t")
    T.create_history(dim, "hist_t")
    attrs, order, stamp = ["name", "email"], [F.desc("last_updated")], "2024-01-10 00:00:00"
    later = spark.createDataFrame([("same", "a2", "a@x", "08"), ("new", "n", "n2@x", "08"), ("newer", "m", None, "08")], SNAP)
    third = spark.createDataFrame([("same", "a3", "a@x", "08"), ("absent", "e9", "e@x", "08")], SNAP)
    want, closed = dim, None
    shown = lambda df: sorted(map(str, df.select("customer_id", "name", "email", "effective_start_date", "effective_end_date", "is_current", "updated_time").collect()))
    for n, (snap, day) in enumerate([(snapshot, D1), (later, D2), (third, date(2024, 2, 1))]):
        want = H.scd2_apply(want, snap, "customer_id", attrs, day, order=order, stamp=stamp)
        for again in range(2):
            before = set(spark.table("hist_t").inputFiles())
            changed = T.apply_snapshot(snap, "hist_t", "customer_id", attrs, day, f"b{n}", order=order, stamp=stamp)
            spark.catalog.refreshTable("hist_t")
            files = set(spark.table("hist_t").inputFiles())
            assert changed == (again == 0)
            if again:
                assert files == before
            else:
                assert {f for f in before if "is_current=false" in f} <= files
        stored = T.versions(spark.table("hist_t"))
        assert shown(stored) == shown(want) and stored.count() == stored.select("customer_sk").distinct().count()
    assert spark.table("hist_t").filter("is_current").select("closed_in").distinct().count() == 1
    # a batch that closes more later keeps what it closed before
    fourth = spark.createDataFrame([("filled", "zz", "c@x", "08")], SNAP)
    n = spark.table("hist_t").count()
    T.apply_snapshot(fourth, "hist_t", "customer_id", attrs, date(2024, 2, 1), "b2", stamp=stamp)
    assert spark.table("hist_t").count() == n + 1
    spark.sql("DROP TABLE hist_t")


def test_a_run_that_dies_between_its_writes_is_replayed(spark, dim, snapshot, monkeypatch):
    from smeltry.sources import history_table as T
    from smeltry.sources import sinks

    spark.sql("DROP TABLE IF EXISTS hist_u")
    T.create_history(dim, "hist_u")
    args = ("hist_u", "customer_id", ["name", "email"], D1, "b")
    real, calls = sinks.overwrite_partition, []

    def dies(df, *a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        real(df, *a)

    with monkeypatch.context() as m:
        m.setattr(sinks, "overwrite_partition", dies)
        with pytest.raises(RuntimeError):
            T.apply_snapshot(snapshot, *args, order=[F.desc("last_updated")], stamp="2024-01-10 00:00:00")
    assert T.apply_snapshot(snapshot, *args, order=[F.desc("last_updated")], stamp="2024-01-10 00:00:00")
    want = run(dim, snapshot, D1).select("customer_id", "name", "email", "effective_start_date", "effective_end_date", "is_current")
    assert sorted(map(str, T.versions(spark.table("hist_u")).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert not [t.name for t in spark.catalog.listTables() if "__scd2_" in t.name]
    spark.sql("DROP TABLE hist_u")
