"""Checks over whole tables or several tables, as result rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from smeltry.functions import columns as C
from smeltry.operators.history import interval_breaks
from smeltry.operators.joins import orphans
from smeltry.operators.rows import EVENT_TYPES
from smeltry.plans.gold import daily_channel_sales
from smeltry.plans.late import key_presence
from smeltry.quality import rules as Q
from smeltry.sources.files import scan_slice


def _rows(df: DataFrame, table: str, items: Sequence[tuple[str, str, str, Column, Column, float | None]]) -> DataFrame:
    """Result rows from a one-row frame; items are (check, column, metric, value, bad, threshold)."""
    structs = [
        F.struct(
            F.lit(table).alias("table_name"), F.lit(check).alias("check_name"),
            F.lit(column).alias("column_name"),
            F.when(bad, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("status"),
            F.lit(metric).alias("metric"), value.cast("double").alias("observed"),
            F.lit(threshold).cast("double").alias("threshold"),
        )
        for check, column, metric, value, bad, threshold in items
    ]
    return df.select(F.inline(F.array(*structs)))


def schema_check(
    df: DataFrame, table: str, columns: Sequence[str] = (), types: Mapping[str, str] | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Missing or mistyped columns fail; extra columns only pass as a note."""
    actual = dict(df.dtypes)
    rows = []
    for c in list(columns) + [c for c in required if c not in columns]:
        ok = c in actual
        rows.append((table, "schema", c, "PASS" if ok else "FAIL", "present", float(ok), 1.0))
    for c, want in (types or {}).items():
        if c in actual:
            ok = actual[c] == want
            rows.append((table, "schema", c, "PASS" if ok else "FAIL", "type_matches", float(ok), 1.0))
    if columns:
        for c in sorted(set(actual) - set(columns)):
            rows.append((table, "schema", c, "PASS", "extra_column", 1.0, None))
    return Q._literal_rows(df, rows)


def referential_integrity(df: DataFrame, table: str, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Rows whose foreign key has no (current) parent, per key column."""
    out = None
    for fk, parent in parents.items():
        if fk not in df.columns:
            continue
        lost = orphans(df, fk, parent).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
        part = _rows(
            lost, table,
            [("referential_integrity", fk, "orphaned_count", F.col("n"), F.col("n") > 0, 0.0)],
        )
        out = part if out is None else out.unionByName(part)
    return out


def scd_integrity(dim: DataFrame, table: str, key: str = "customer_id", sk: str = "customer_sk") -> DataFrame:
    """Keys with several current rows, reversed intervals, overlaps and gaps."""
    per_key = (
        dim.groupBy(key)
        .agg(
            F.count_if("is_current").alias("_current"),
            F.count_if(F.col("effective_start_date") > F.col("effective_end_date")).alias("_reversed"),
        )
        .agg(
            F.count_if(F.col("_current") > 1).alias("multi"),
            F.coalesce(F.sum("_reversed"), F.lit(0)).alias("reversed"),
        )
    )
    first = _rows(
        per_key, table,
        [
            ("scd_integrity", key, "multiple_current", F.col("multi"), F.col("multi") > 0, 0.0),
            ("scd_integrity", key, "start_after_end", F.col("reversed"), F.col("reversed") > 0, 0.0),
        ],
    )
    second = _rows(
        interval_breaks(dim, key, sk), table,
        [
            ("scd_integrity", key, "overlapping_versions", F.col("overlaps"), F.col("overlaps") > 0, 0.0),
            ("scd_integrity", key, "gaps_between_versions", F.col("gaps"), F.lit(False), None),
        ],
    )
    return first.unionByName(second)


def freshness(df: DataFrame, table: str, ts: str, as_of: datetime | str, hours: float) -> DataFrame:
    """Hours between the newest row and ``as_of``; none or too old fails."""
    lag = C.hours_between(F.col("newest"), F.lit(as_of).cast("timestamp"))
    return _rows(
        df.agg(F.max(ts).alias("newest")), table,
        [("freshness", ts, "hours_since_newest", lag, lag.isNull() | (lag > hours), float(hours))],
    )


def volume(
    df: DataFrame, ts: str, low: int | None = None, high: int | None = None, tolerance: float = 0.5,
) -> DataFrame:
    """Rows per day against fixed bounds and against the mean of all earlier days.

    The window runs over one row per day.
    """
    days = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    graded = days.withColumn("prior_mean", F.round(F.avg("rows").over(before), 4))
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col("rows") < low)
    if high is not None:
        bad = bad | (F.col("rows") > high)
    drift = F.abs(F.col("rows") - F.col("prior_mean")) > F.col("prior_mean") * tolerance
    status = F.when(bad, "FAIL").when(F.coalesce(drift, F.lit(False)), "WARN").otherwise("PASS")
    return graded.withColumn("status", status)


def consistency(bronze: DataFrame, bronze_key: str, silver: DataFrame, silver_key: str, table: str) -> DataFrame:
    """Keys present on one side only."""
    sides = key_presence(bronze, bronze_key, silver, silver_key).agg(
        F.count_if(F.col("in_right") & ~F.col("in_left")).alias("extra"),
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("missing"),
    )
    return _rows(
        sides, table,
        [
            ("consistency", silver_key, "not_in_bronze", F.col("extra"), F.col("extra") > 0, 0.0),
            ("consistency", silver_key, "not_in_silver", F.col("missing"), F.col("missing") > 0, 0.0),
        ],
    )


def metrics_validation(metrics: DataFrame, fact: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Stored daily channel metrics against their recomputation from the fact table.

    A metric row without facts, facts without a metric row and a NULL on one side
    fail. Days and channels that are NULL are compared like any other.
    """
    again = daily_channel_sales(fact).select(
        "date_id", "channel", F.col("total_revenue").alias("fact_revenue"),
        F.col("total_transactions").alias("fact_transactions"),
    )
    again = again.withColumnsRenamed({"date_id": "_date", "channel": "_channel"}).withColumn("_fact", F.lit(True))
    stored = metrics.withColumn("_metric", F.lit(True))
    same = F.col("date_id").eqNullSafe(F.col("_date")) & F.col("channel").eqNullSafe(F.col("_channel"))
    near = F.abs(F.col("total_revenue") - F.col("fact_revenue")).cast("double") <= tolerance
    good = (
        F.col("_metric") & F.col("_fact")
        & (near | (F.col("total_revenue").isNull() & F.col("fact_revenue").isNull()))
        & F.col("total_transactions").eqNullSafe(F.col("fact_transactions"))
    )
    return stored.join(again, same, "full").select(
        F.coalesce("date_id", "_date").alias("date_id"), F.coalesce("channel", "_channel").alias("channel"),
        "total_revenue", "fact_revenue",
        F.when(F.coalesce(good, F.lit(False)), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
    )


def cross_layer_reconciliation(
    layers: Sequence[tuple[str, DataFrame, str, str]], rejected: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows and revenue per day of each layer, side by side.

    ``layers`` are (name, frame, time column, amount column). Layers are reduced
    to days, stacked and regrouped, so nothing is joined. All rows of a layer are
    read; those that ``rejected`` says the next layer refuses are reported as
    ``{name}_rejected_rows`` and ``_revenue``, beside the others.
    """
    refused = rejected or {}
    stacked = None
    for name, df, ts, amount in layers:
        no = F.coalesce(refused.get(name, F.lit(False)), F.lit(False))
        daily = df.groupBy(F.to_date(ts).alias("day")).agg(
            F.count_if(~no).alias("rows"),
            F.sum(F.when(~no, F.col(amount))).cast("decimal(38,2)").alias("revenue"),
            F.count_if(no).alias("rejected_rows"),
            F.sum(F.when(no, F.col(amount))).cast("decimal(38,2)").alias("rejected_revenue"),
        ).withColumn("layer", F.lit(name))
        stacked = daily if stacked is None else stacked.unionByName(daily)
    aggs = []
    for name in refused:
        for what in ("rejected_rows", "rejected_revenue"):
            aggs.append(F.coalesce(F.sum(F.when(F.col("layer") == name, F.col(what))), F.lit(0)).alias(f"{name}_{what}"))
    for name, *_ in layers:
        mine = F.col("layer") == name
        aggs.append(F.coalesce(F.sum(F.when(mine, F.col("rows"))), F.lit(0)).alias(f"{name}_rows"))
        aggs.append(F.coalesce(F.sum(F.when(mine, F.col("revenue"))), F.lit(0)).alias(f"{name}_revenue"))
    names = [n for n, *_ in layers]
    agree = C.all_of(
        [F.col(f"{a}_{m}") == F.col(f"{b}_{m}") for a, b in zip(names, names[1:]) for m in ("rows", "revenue")]
    )
    return stacked.groupBy("day").agg(*aggs).withColumn(
        "status", F.when(agree, F.lit("PASS")).otherwise(F.lit("FAIL"))
    )


def silver_post_load(df: DataFrame, table: str, key: str, required: Sequence[str], date_col: str, day: date | str | None = None) -> DataFrame:
    """Row count, NULL keys and duplicated keys of a loaded slice, or of the whole table."""
    part = scan_slice(df, date_col, day)
    rules = [
        Q.Rule("post_load", "*", "row_count", F.count(F.lit(1)), lambda v, t: F.when(v == 0, "WARN").otherwise("PASS"))
    ]
    rules += [
        Q.Rule("post_load", c, "null_count", F.count_if(F.col(c).isNull()), lambda v, t: F.when(v > 0, "WARN").otherwise("PASS"), 0.0, needs=(c,))
        for c in required
    ]
    counted = Q.run_rules(part, table, rules)
    dup = part.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    dups = dup.select(
        F.lit(table).alias("table_name"), F.lit("post_load").alias("check_name"),
        F.lit(key).alias("column_name"),
        F.when(F.col("n") > 0, F.lit("WARN")).otherwise(F.lit("PASS")).alias("status"),
        F.lit("duplicate_keys").alias("metric"), F.col("n").cast("double").alias("observed"),
        F.lit(0.0).alias("threshold"),
    )
    return counted.unionByName(dups)


def validate_table(
    df: DataFrame, table: str, config: Mapping, parents: Mapping[str, DataFrame] | None = None,
    slice_of: Callable[[DataFrame], DataFrame] | None = None,
    run: Callable[[DataFrame, str, Sequence[Q.Rule]], DataFrame] = Q.run_rules,
) -> DataFrame:
    """All configured checks of one table as result rows.

    ``slice_of`` narrows the rows that are checked, for example to a day with
    ``day_slice``; parents are always whole.
    """
    parts = []
    if slice_of is not None:
        df = slice_of(df)
    expected = config.get("expected_schema", {})
    if expected or config.get("required_columns"):
        parts.append(
            schema_check(df, table, expected.get("columns", ()), expected.get("types"), config.get("required_columns", ()))
        )
    rules = Q.rules_from_config(config, df.columns)
    if rules:
        parts.append(run(df, table, rules))
    refs = {k: parents[v] for k, v in config.get("referential_integrity", {}).items() if parents and v in parents}
    if refs:
        parts.append(referential_integrity(df, table, refs))
    if isinstance(config.get("business_rules"), Mapping) and config["business_rules"].get("scd_integrity"):
        parts.append(scd_integrity(df, table))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def day_slice(ts: str, day: date | str | None, partition: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Narrows a table to a day, reading only that day's partition where one is named."""
    return lambda df: scan_slice(df, ts, day, partition=partition)


def validate_layer(
    tables: Mapping[str, DataFrame], configs: Mapping[str, Mapping], parents: Mapping[str, DataFrame] | None = None,
    slices: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """All checks of a layer's configured tables, of whole tables or of ``slices`` by table."""
    out = None
    for name, df in tables.items():
        if name not in configs:
            continue
        part = validate_table(df, name, configs[name], parents, (slices or {}).get(name))
        out = part if out is None else out.unionByName(part)
    return out


# --- fixed values: rules per layer and table ---------------------------------
LAYER_RULES = {
    "bronze": {
        "raw_user_events": {
            "required_columns": ["event_id", "customer_id", "event_type", "event_time"],
            "unique_columns": ["event_id"],
            "non_null_columns": ["event_id", "event_type", "event_time"],
            "valid_values": {
                "event_type": list(EVENT_TYPES)
            },
            "range_checks": {"event_time": {"min_date": "2024-01-01", "max_date": "2025-12-31"}},
        },
        "raw_marketplace_sales": {
            "required_columns": ["transaction_id", "product_id", "amount", "transaction_time"],
            "unique_columns": ["transaction_id"],
            "non_null_columns": ["transaction_id", "product_id", "amount"],
            "range_checks": {"amount": {"min_value": 0, "max_value": 10000}},
        },
    },
    "silver": {
        "standardized_user_events": {
            "required_columns": ["event_id", "customer_id", "event_type", "event_time"],
            "unique_columns": ["event_id"],
            "non_null_columns": ["event_id", "event_type", "event_time"],
            "referential_integrity": {"customer_id": "dim_customer_scd"},
        },
        "standardized_sales": {
            "required_columns": ["sale_id", "product_id", "total_amount", "transaction_time"],
            "unique_columns": ["sale_id"],
            "non_null_columns": ["sale_id", "product_id", "total_amount"],
            "range_checks": {"total_amount": {"min_value": 0, "max_value": 50000}},
        },
        "dim_customer_scd": {
            "required_columns": ["customer_sk", "customer_id", "effective_start_date", "is_current"],
            "unique_columns": ["customer_sk"],
            "non_null_columns": ["customer_sk", "customer_id"],
            "business_rules": {"scd_integrity": True, "current_record_check": True},
        },
    },
    "gold": {
        "fact_sales": {
            "required_columns": ["sale_id", "product_id", "customer_sk", "total_amount"],
            "unique_columns": ["sale_id"],
            "non_null_columns": ["sale_id", "product_id", "total_amount"],
            "referential_integrity": {"customer_sk": "dim_customer_scd", "product_id": "dim_product"},
        },
        "customer_product_interactions": {
            "required_columns": ["customer_id", "product_id", "feature_date"],
            "non_null_columns": ["customer_id", "product_id", "feature_date"],
            "range_checks": {
                "view_count_7d": {"min_value": 0, "max_value": 1000},
                "category_affinity_score": {"min_value": 0, "max_value": 1},
            },
        },
    },
}
# -----------------------------------------------------------------------------
