"""Profiles as long-form rows (column_name, data_type, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smeltry.operators import aggregates as A
from smeltry.sources.sinks import file_sizes


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _long(df: DataFrame, items: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    aggs = [v.cast("double").alias(f"_m{i}") for i, (_, _, _, v) in enumerate(items)]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"),
            F.lit(metric).alias("metric"), F.col(f"_m{i}").alias("value"),
        )
        for i, (c, kind, metric, _) in enumerate(items)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def _distinct(columns: Sequence[str], kind: str, approximate: bool):
    """Distinct values, NULL counting as one as in a DISTINCT listing."""
    for c in columns:
        if approximate:
            n = F.approx_count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))
        else:
            n = F.count_distinct(F.struct(c))
        yield (c, kind, "distinct_count", n)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, distinct: bool = True, approximate: bool = False,
) -> DataFrame:
    """Count, mean, stddev, min, max, NULLs and distinct values of numeric columns.

    Exact distinct counts shuffle each column's values, so they run apart from
    the one-pass statistics; ``approximate`` replaces them by bounded sketches.
    """
    cols = list(columns) if columns is not None else A.numeric_columns(df)
    items = []
    for c in cols:
        v = F.col(c).cast("double")
        items += [
            (c, "numeric", "count", F.count(c)), (c, "numeric", "mean", F.avg(v)),
            (c, "numeric", "stddev", F.stddev(v)), (c, "numeric", "min", F.min(v)),
            (c, "numeric", "max", F.max(v)),
            (c, "numeric", "null_count", F.count_if(F.col(c).isNull())),
        ]
    parts = [_long(df, items)]
    if distinct:
        parts.append(_long(df, list(_distinct(cols, "numeric", approximate))))
    return _union(parts)


def profile_string(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False,
) -> DataFrame:
    """NULLs, distinct values, mean and longest length of text columns."""
    cols = list(columns) if columns is not None else string_columns(df)
    items = []
    for c in cols:
        n = F.length(c)
        items += [
            (c, "string", "null_count", F.count_if(F.col(c).isNull())),
            (c, "string", "avg_length", F.avg(n)), (c, "string", "max_length", F.max(n)),
        ]
    return _union([_long(df, items), _long(df, list(_distinct(cols, "string", approximate)))])


def basic_profile(df: DataFrame) -> DataFrame:
    """Row and column counts, and the statistics of the numeric columns."""
    table = _long(
        df,
        [("*", "table", "row_count", F.count(F.lit(1))),
         ("*", "table", "column_count", F.max(F.lit(len(df.columns))))],
    )
    return table.unionByName(profile_numeric(df, distinct=False))


def profile_table(df: DataFrame, approximate: bool = True) -> DataFrame:
    """Numeric and text profiles plus strong correlations, in one long form."""
    parts = []
    numeric, text = A.numeric_columns(df), string_columns(df)
    if numeric:
        parts.append(profile_numeric(df, numeric, approximate=approximate))
    if text:
        parts.append(profile_string(df, text, approximate))
    if len(numeric) > 1:
        parts.append(
            A.correlations(df, numeric).select(
                F.concat_ws("_vs_", "column_a", "column_b").alias("column_name"),
                F.lit("correlation").alias("data_type"), F.lit("pearson").alias("metric"),
                F.col("r").alias("value"),
            )
        )
    return _union(parts)


def flag_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5, accuracy: int = 10_000, exact: bool = False) -> DataFrame:
    """``{column}_is_outlier`` by the interquartile fence, NULL values not flagged.

    The quartiles of all columns come from one aggregate read as a scalar
    subquery: nothing is joined. ``exact`` narrows brackets in rounds that run
    when this is called, see ``exact_quantiles``.
    """
    q = (A.exact_quantiles if exact else A.quantiles)(df, columns, accuracy)
    fences = q.select(F.struct(*q.columns).alias("q")).scalar()
    new = {}
    for c in columns:
        low, high = fences[f"{c}_q1"], fences[f"{c}_q3"]
        span = high - low
        outside = (F.col(c) < low - k * span) | (F.col(c) > high + k * span)
        new[f"{c}_is_outlier"] = F.coalesce(outside, F.lit(False))
    return df.withColumns(new)


# --- fixed values: file health ------------------------------------------------
SMALL_FILE_BYTES = 64 * 1024 * 1024
SMALL_FILE_SHARE = 0.3
SMALL_FILE_PENALTY = 20
MANY_PARTITIONS = 1000
MANY_PARTITIONS_PENALTY = 15
# ------------------------------------------------------------------------------


def file_health(df: DataFrame, small_bytes: int = SMALL_FILE_BYTES) -> DataFrame:
    """File count, sizes, share of small files, score and grade of a file-based scan."""
    f = file_sizes(df).withColumn("folder", F.regexp_replace("file_path", r"/[^/]*$", ""))
    stats = f.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"),
        F.avg("file_size").alias("avg_bytes"),
        F.count_if(F.col("file_size") < small_bytes).alias("small_files"),
        F.count_distinct("folder").alias("partitions"),
    )
    fragmented = F.col("small_files") > F.col("total_files") * SMALL_FILE_SHARE
    crowded = F.col("partitions") > MANY_PARTITIONS
    score = (
        F.lit(100)
        - F.when(fragmented, SMALL_FILE_PENALTY).otherwise(0)
        - F.when(crowded, MANY_PARTITIONS_PENALTY).otherwise(0)
    )
    grade = (
        F.when(F.col("health_score") >= 90, "EXCELLENT").when(F.col("health_score") >= 70, "GOOD")
        .when(F.col("health_score") >= 50, "FAIR").otherwise("POOR")
    )
    return stats.withColumn("health_score", score).withColumns(
        {
            "status": grade,
            "advice": F.concat_ws(
                "; ",
                F.when(fragmented, F.lit("compact small files")),
                F.when(crowded, F.lit("review partitioning")),
            ),
        }
    )
