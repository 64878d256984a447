"""Roll-ups of result rows: check to table to layer to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smeltry.functions import columns as C

# --- fixed values -----------------------------------------------------------
EXPECTATION_WARNING_PERCENT = 80
ALERT_PERCENT = 85
# ----------------------------------------------------------------------------


def _label(level: Column, names: tuple[str, str, str, str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (level + 1).cast("int"))


SHORT = ("PASS", "WARN", "FAIL", "ERROR")
LONG = ("PASSED", "WARNING", "FAILED", "ERROR")


def status_by(results: DataFrame, *keys: str) -> DataFrame:
    """Worst status and status counts of result rows per group, or overall."""
    s = F.col("status")
    aggs = [
        _label(F.max(C.severity(s)), SHORT).alias("status"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(s == "PASS").alias("passed"),
        F.count_if(s == "WARN").alias("warnings"),
        F.count_if(s.isin("FAIL", "ERROR")).alias("failed"),
    ]
    return results.groupBy(*keys).agg(*aggs) if keys else results.agg(*aggs)


def layer_status(results: DataFrame, layer: str) -> DataFrame:
    """Check rows to tables, tables to one row for the layer."""
    tables = status_by(results, "table_name")
    return tables.agg(
        F.lit(layer).alias("layer"),
        _label(F.max(F.least(C.severity(F.col("status")), F.lit(2))), SHORT).alias("status"),
        F.count(F.lit(1)).alias("tables"),
        F.sum("checks").alias("checks"), F.sum("passed").alias("passed"),
        F.sum("warnings").alias("warnings"), F.sum("failed").alias("failed"),
    )


def _percent(passed: Column, total: Column) -> Column:
    return F.round(F.coalesce(passed.cast("double") * 100 / F.when(total != 0, total), F.lit(0.0)), 4)


def expectation_status(results: DataFrame, *keys: str) -> DataFrame:
    """Suite rows to one row per table: none failed passes, 80 % or more warns, less fails."""
    keys = keys or ("table_name",)
    counted = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("passed")
    ).withColumns(
        {"failed": F.col("total") - F.col("passed"), "success_percent": _percent(F.col("passed"), F.col("total"))}
    )
    status = (
        F.when(F.col("failed") == 0, F.lit("PASSED"))
        .when(F.col("success_percent") >= EXPECTATION_WARNING_PERCENT, F.lit("WARNING"))
        .otherwise(F.lit("FAILED"))
    )
    return counted.withColumn("status", status)


def _worst_of_tables(tables: DataFrame, *keys: str) -> DataFrame:
    s = F.col("status")
    aggs = [
        F.count(F.lit(1)).alias("tables"),
        F.count_if(s == "PASSED").alias("tables_passed"),
        F.count_if(s == "WARNING").alias("tables_warning"),
        F.count_if(s.isin("FAILED", "ERROR")).alias("tables_failed"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
    ]
    out = tables.groupBy(*keys).agg(*aggs)
    overall = (
        F.when(F.col("tables_failed") > 0, F.lit("FAILED"))
        .when(F.col("tables_warning") > 0, F.lit("WARNING"))
        .otherwise(F.lit("PASSED"))
    )
    return out.withColumns(
        {"success_percent": _percent(F.col("passed"), F.col("total")), "status": overall}
    )


def expectation_layer_status(tables: DataFrame, *keys: str) -> DataFrame:
    """Tables (``expectation_status`` rows with the keys added) to layers."""
    return _worst_of_tables(tables, *(keys or ("layer",)))


def hybrid_status(rule_results: DataFrame, suite_results: DataFrame) -> DataFrame:
    """Both kinds of results combined per table: counts added, worst status wins."""
    by_rules = rule_results.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"),
        F.max(C.severity(F.col("status"))).alias("level"),
    )
    suites = expectation_status(suite_results)
    by_suites = suites.select(
        "table_name", "total", "passed", C.severity(F.col("status")).alias("level")
    )
    return (
        by_rules.unionByName(by_suites).groupBy("table_name")
        .agg(F.sum("total").alias("total"), F.sum("passed").alias("passed"), F.max("level").alias("level"))
        .withColumns(
            {
                "failed": F.col("total") - F.col("passed"),
                "success_percent": _percent(F.col("passed"), F.col("total")),
                "status": _label(F.col("level"), LONG),
            }
        )
        .drop("level")
    )


def hybrid_layer_status(tables: DataFrame) -> DataFrame:
    """``hybrid_status`` rows to one layer row."""
    return _worst_of_tables(tables)


def alerts(layer: DataFrame, name: str) -> DataFrame:
    """A CRITICAL row for a failed layer and a WARNING row below 85 % success."""
    critical = F.when(F.col("status") == "FAILED", F.lit("CRITICAL"))
    low = F.when(F.col("success_percent") < ALERT_PERCENT, F.lit("WARNING"))
    return layer.select(
        F.lit(name).alias("layer"),
        F.explode(F.array_compact(F.array(critical, low))).alias("severity"),
        "tables_failed", "success_percent",
    )


def run_summary(layers: DataFrame) -> DataFrame:
    """Layers to one row: passed and failed layers, tables, expectations, overall status."""
    ok = F.col("status").isin("PASSED", "WARNING")
    out = layers.agg(
        F.count(F.lit(1)).alias("layers"), F.count_if(ok).alias("layers_passed"),
        F.count_if(~ok).alias("layers_failed"), F.sum("tables").alias("tables"),
        F.sum("tables_passed").alias("tables_passed"), F.sum("tables_failed").alias("tables_failed"),
        F.sum("total").alias("expectations"), F.sum("passed").alias("expectations_passed"),
        F.sum("failed").alias("expectations_failed"),
    )
    status = (
        F.when(F.col("layers_failed") == 0, F.lit("PASSED"))
        .when(F.col("layers_passed") > F.col("layers_failed"), F.lit("WARNING"))
        .otherwise(F.lit("FAILED"))
    )
    return out.withColumn("status", status)
