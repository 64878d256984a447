"""Profiles that are kept by day and merged, instead of scanning a table again.

A day's row for a column holds counts, sums and extremes, a HyperLogLog sketch of its
values and a KLL sketch of its numbers. All of these merge, so the profile of any set of
days comes from their rows. Counts, extremes and means are exact; distinct counts have a
standard error of 1.04 / sqrt(2**LOG_K), quantiles a rank error of about 1.7 / KLL_K.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from smeltry.operators import aggregates as A
from smeltry.profiling.profile import string_columns
from smeltry.sources import sinks

#: Registers of a distinct sketch, as a power of two; size of a quantile sketch.
LOG_K, KLL_K = 12, 400
MERGED = {"q1": 0.25, "median": 0.5, "q3": 0.75}
SLICE = (
    "column_name string, data_type string, rows bigint, present bigint, low double, high double, total double, squares double, "
    "distinct_sketch binary, quantile_sketch binary, day date"
)


def slice_sketches(df: DataFrame, day: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each column and day, from one aggregate. Numbers count by value, texts by length.

    ``squares`` is the sum of squared distances from the day's own mean, which loses no
    digits to large values. Columns of other types are left out.
    """
    wanted = list(columns) if columns is not None else df.columns
    numeric = [c for c in A.numeric_columns(df) if c in wanted]
    text = [c for c in string_columns(df) if c in wanted]
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, c in enumerate([*numeric, *text]):
        kind = "numeric" if c in numeric else "string"
        v = (F.col(c) if kind == "numeric" else F.length(c)).cast("double")
        own = {
            "present": F.count(c), "low": F.min(v), "high": F.max(v), "total": F.sum(v), "squares": F.var_pop(v) * F.count(v),
            "distinct_sketch": F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), F.lit(LOG_K)),
            "quantile_sketch": F.kll_sketch_agg_double(v, F.lit(KLL_K)),
        }
        aggs += [a.alias(f"_{n}{i}") for n, a in own.items()]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"), F.col("_rows").alias("rows"), *[F.col(f"_{n}{i}").alias(n) for n in own]))
    return df.groupBy(day.cast("date").alias("day")).agg(*aggs).select(F.inline(F.array(*rows)), "day")


def merged_profile(slices: DataFrame, probs: Mapping[str, float] = MERGED) -> DataFrame:
    """Profile of all days in ``slices`` as rows (column_name, data_type, metric, value)."""
    n, mean = F.sum("present"), F.sum("total") / F.when(F.sum("present") > 0, F.sum("present"))
    # distances of the days' means are taken from one of these means, so large values lose no digits
    own = F.col("total") / F.when(F.col("present") > 0, F.col("present"))
    slices = slices.withColumn("_off", own - F.min(own).over(W.partitionBy("column_name", "data_type")))
    off = F.sum(F.col("_off") * F.col("present"))
    between = F.sum(F.col("_off") * F.col("_off") * F.col("present")) - off * off / F.when(n > 0, n)
    merged = slices.groupBy("column_name", "data_type").agg(
        F.sum("rows").alias("_rows"), n.alias("count"), mean.alias("mean"), F.min("low").alias("min"), F.max("high").alias("max"),
        F.when(n > 1, F.sqrt((F.sum("squares") + F.greatest(between, F.lit(0.0))) / (n - 1))).alias("stddev"),
        F.hll_union_agg("distinct_sketch").alias("_distinct"), F.kll_merge_agg_double(F.when(F.col("present") > 0, F.col("quantile_sketch"))).alias("_quantiles"),
    )
    nulls = F.col("_rows") - F.col("count")
    metrics = {
        "count": F.col("count"), "null_count": nulls, "mean": F.col("mean"), "stddev": F.col("stddev"), "min": F.col("min"), "max": F.col("max"),
        # NULL counts as a value, as in the other profiles
        "distinct_count": F.hll_sketch_estimate("_distinct") + F.when(nulls > 0, 1).otherwise(0),
    }
    metrics |= {name: F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("_quantiles", F.lit(p))) for name, p in probs.items()}
    each = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()])
    return merged.select("column_name", "data_type", F.inline(each))


def refresh_slices(df: DataFrame, slice_table: str, day: str, days: DataFrame, columns: Sequence[str] | None = None) -> None:
    """Sketches the named days of a table anew and replaces their stored rows.

    ``day`` is the table's partition column, ``days`` holds its values to be read in a
    column ``day``; other partitions are not listed. The stored table is partitioned by
    day and made if it is not there. A replay gives the same rows.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(slice_table):
        spark.createDataFrame([], SLICE).write.partitionBy("day").format("parquet").saveAsTable(slice_table)
    wanted = days.select(F.col("day").cast(dict(df.dtypes)[day]).alias(day)).distinct()
    fresh = slice_sketches(sinks.in_slices(df, day, wanted), F.col(day), columns)
    sinks.replace_slices_in_table(fresh, slice_table, "day", days.select(F.col("day").cast("date").alias("day")).distinct())
