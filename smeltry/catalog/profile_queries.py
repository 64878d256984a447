"""Profiles and outliers."""

from pyspark.sql import functions as F

from smeltry.catalog.registry import query
from smeltry.profiling import profile as P

NUMERIC = ["l_quantity", "l_extendedprice", "l_linenumber"]


def numeric_rows(table, column, distinct=True):
    stats = {
        "count": f"count({column})", "mean": f"avg({column})", "stddev": f"stddev({column})", "min": f"min({column})",
        "max": f"max({column})", "null_count": f"count(*) - count({column})",
    }
    if distinct:
        stats["distinct_count"] = f"count(DISTINCT {column}) + CAST(count(*) > count({column}) AS INTEGER)"
    return " UNION ALL ".join(
        f"SELECT '{column}' AS column_name, 'numeric' AS data_type, '{m}' AS metric, round(CAST({v} AS DOUBLE), 4) AS value FROM {table}"
        for m, v in stats.items()
    )


def string_rows(table, column):
    stats = {
        "null_count": f"count(*) - count({column})", "avg_length": f"avg(length({column}))", "max_length": f"max(length({column}))",
        "distinct_count": f"count(DISTINCT {column}) + CAST(count(*) > count({column}) AS INTEGER)",
    }
    return " UNION ALL ".join(
        f"SELECT '{column}' AS column_name, 'string' AS data_type, '{m}' AS metric, round(CAST({v} AS DOUBLE), 4) AS value FROM {table}"
        for m, v in stats.items()
    )


def _rounded(df):
    return df.withColumn("value", F.round("value", 4))


@query("profile_numeric", " UNION ALL ".join(numeric_rows("lineitem", c) for c in NUMERIC))
def _(w):
    return _rounded(P.profile_numeric(w.table("lineitem"), NUMERIC))


@query("profile_string", " UNION ALL ".join(string_rows("bronze_events", c) for c in ("customer_id", "page_url", "event_type")))
def _(w):
    return _rounded(P.profile_string(w.bronze_events, ["customer_id", "page_url", "event_type"]))


@query(
    "basic_profile",
    "SELECT '*' AS column_name, 'table' AS data_type, 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM part "
    "UNION ALL SELECT '*', 'table', 'column_count', CAST(6 AS DOUBLE) UNION ALL "
    + " UNION ALL ".join(numeric_rows("part", c, distinct=False) for c in ("p_partkey", "p_size", "p_retailprice")),
)
def _(w):
    return _rounded(P.basic_profile(w.table("part")))


@query(
    "profile_table",
    " UNION ALL ".join(
        [numeric_rows("part", c) for c in ("p_partkey", "p_size", "p_retailprice")]
        + [string_rows("part", c) for c in ("p_name", "p_brand", "p_type")]
        + [
            f"SELECT '{a}_vs_{b}' AS column_name, 'correlation' AS data_type, 'pearson' AS metric, r AS value FROM (SELECT round(corr({a}, {b}), 4) AS r FROM part) WHERE abs(r) > 0.5"
            for a, b in (("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice"))
        ]
    ),
)
def _(w):
    return _rounded(P.profile_table(w.table("part"), approximate=False))


@query(
    "flag_outliers",
    """WITH q AS (SELECT quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM events)
    SELECT event_id, value, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS value_is_outlier FROM events, q""",
)
def _(w):
    return P.flag_outliers(w.table("events").select("event_id", "value"), ["value"], exact=True)
