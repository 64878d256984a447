"""Incremental validation: rule counters by day, which are stored and added up.

A row rule is a count of bad rows, over another count where it is a share. Counts of
days add up, so a run counts the days that changed and adds the stored counts of the
others: the table's history is not read again. Rules on distinct keys don't add up; they
read their key columns of the whole table, as in ``rules.run_rules``.

A counter carries its rule's fingerprint, the text of its expressions: after a rule is
changed its old counters are not found, and ``uncounted_days`` names what to count anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smeltry.quality import checks as Q
from smeltry.quality import rules as R
from smeltry.sources import sinks

#: The counter of all rows of a day.
ROWS = "rows"
COUNTER = "table_name string, rule string, bad bigint, base bigint, day date"


def fingerprint(rule: R.Rule) -> str:
    text = "|".join(map(str, (rule.check, rule.column, rule.metric, rule.bad, rule.base)))
    return hashlib.md5(text.encode()).hexdigest()


def adds_up(rule: R.Rule, columns: Sequence[str]) -> bool:
    return rule.bad is not None and set(rule.needs) <= set(columns)


def rule_counters(df: DataFrame, table: str, rules: Sequence[R.Rule], day: Column) -> DataFrame:
    """table_name, rule, bad, base, day: one row for each rule and day of ``df``, from one aggregate.

    Rows without a day are a day of their own (NULL).
    """
    some = [r for r in rules if adds_up(r, df.columns) and R.resolves(df, r.condition)]
    none = F.lit(0).cast("bigint")
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, r in enumerate(some):
        aggs += [r.bad.alias(f"_bad{i}"), (none if r.base is None else r.base).alias(f"_base{i}")]
    parts = [F.struct(F.lit(ROWS).alias("rule"), F.col("_rows").alias("bad"), none.alias("base"))]
    parts += [F.struct(F.lit(fingerprint(r)).alias("rule"), F.col(f"_bad{i}").alias("bad"), F.col(f"_base{i}").alias("base")) for i, r in enumerate(some)]
    counted = df.groupBy(day.cast("date").alias("day")).agg(*aggs)
    return counted.select(F.lit(table).alias("table_name"), F.inline(F.array(*parts)), "day").select("table_name", "rule", "bad", "base", "day")


def results(counters: DataFrame, df: DataFrame, table: str, rules: Sequence[R.Rule]) -> DataFrame:
    """Result rows of all rules, as ``run_rules(df, table, rules)`` gives them.

    Rules that add up come from the counters; only the others read ``df``.
    """
    some = [r for r in rules if adds_up(r, df.columns) and R.resolves(df, r.condition)]
    rest = [r for r in rules if not any(r is s for s in some)]
    total = lambda rule, c: F.coalesce(F.sum(F.when(F.col("rule") == rule, F.col(c))), F.lit(0))
    aggs = [total(ROWS, "bad").alias("_total")]
    for i, r in enumerate(some):
        bad, base = total(fingerprint(r), "bad"), total(fingerprint(r), "base")
        aggs.append((bad if r.base is None else R.share(bad, base)).alias(f"_v{i}"))
    out = None
    if some:
        rows = [R.result(table, r, F.col(f"_v{i}"), F.col("_total")) for i, r in enumerate(some)]
        out = counters.filter(F.col("table_name") == table).agg(*aggs).select(F.inline(F.array(*rows)))
    if rest:
        more = R.run_rules(df, table, rest)
        out = more if out is None else out.unionByName(more)
    return out


def validate_from_counters(
    counters: DataFrame, df: DataFrame, table: str, config: Mapping, parents: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """``checks.validate_table`` of the whole table, its row rules from counters of all its days."""
    return Q.validate_table(df, table, config, parents, run=lambda df, table, rules: results(counters, df, table, rules))


def uncounted_days(counters: DataFrame, days: DataFrame, df: DataFrame, table: str, rules: Sequence[R.Rule]) -> DataFrame:
    """The days (column ``day``) that lack a counter of one of the rules: new days, and all after a rule is changed."""
    wanted = [ROWS, *dict.fromkeys(fingerprint(r) for r in rules if adds_up(r, df.columns) and R.resolves(df, r.condition))]
    mine = counters.filter((F.col("table_name") == table) & F.col("rule").isin(wanted))
    whole = mine.groupBy(F.col("day").alias("_day")).agg(F.count_distinct("rule").alias("n")).filter(F.col("n") == len(wanted))
    return days.select("day").distinct().join(whole, F.col("day").eqNullSafe(F.col("_day")), "left_anti")


def refresh_counters(df: DataFrame, counter_table: str, table: str, rules: Sequence[R.Rule], day: str, days: DataFrame) -> None:
    """Counts the named days of a table anew and replaces their stored counters.

    ``day`` is the table's partition column and ``days`` holds its values to be counted
    in a column ``day``: their bounds reach the scan as literals, so other partitions are
    not listed. Counters are a table partitioned by (table_name, day), made if it is not
    there; a day that has become empty keeps zero counters. A replay gives the same table.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(counter_table):
        spark.createDataFrame([], COUNTER).write.partitionBy("table_name", "day").format("parquet").saveAsTable(counter_table)
    wanted = days.select(F.col("day").cast(dict(df.dtypes)[day]).alias(day)).distinct()
    fresh = rule_counters(sinks.in_slices(df, day, wanted), table, rules, F.col(day))
    empty = days.select(F.col("day").cast("date").alias("day")).distinct().join(
        fresh.select(F.col("day").alias("_day")).distinct(), F.col("day").eqNullSafe(F.col("_day")), "left_anti"
    )
    ids = F.array(*[F.lit(x) for x in (ROWS, *dict.fromkeys(fingerprint(r) for r in rules if adds_up(r, df.columns) and R.resolves(df, r.condition)))])
    zero = F.lit(0).cast("bigint")
    nothing = empty.select(F.lit(table).alias("table_name"), F.explode(ids).alias("rule"), zero.alias("bad"), zero.alias("base"), "day")
    sinks.overwrite_partition(fresh.unionByName(nothing), counter_table, ["table_name", "day"])
