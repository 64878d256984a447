"""Declarative expectation suites.

A suite is data: a name and a list of (type, arguments). Each expectation is one
aggregate; a suite costs one scan, plus one over the key columns when it asks
for uniqueness. An expectation on an absent column fails.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smeltry.functions import columns as C


@dataclass(frozen=True)
class Expectation:
    type: str
    kwargs: Mapping
    meta: Mapping = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        k = self.kwargs
        return [k[n] for n in ("column", "column_A", "column_B") if n in k]


@dataclass(frozen=True)
class Suite:
    name: str
    expectations: tuple[Expectation, ...]


def load_suite(source: str | Path | Mapping) -> Suite:
    """A suite from its JSON document, a path to it, or the parsed mapping."""
    if isinstance(source, Mapping):
        doc = source
    else:
        text = str(source)
        doc = json.loads(text if text.lstrip().startswith("{") else Path(text).read_text())
    return Suite(
        doc["expectation_suite_name"],
        tuple(
            Expectation(e["expectation_type"], e.get("kwargs", {}), e.get("meta", {}))
            for e in doc["expectations"]
        ),
    )


def _typed(df: DataFrame, column: str, value) -> Column:
    """A bound in the column's own terms; text bounds become timestamps or dates."""
    dtype = df.schema[column].dataType
    if isinstance(value, str) and isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(value).cast(dtype)
    return F.lit(value)


def _unexpected(df: DataFrame, e: Expectation) -> Column | None:
    """Aggregate counting rows against a column expectation; None for unknown types."""
    k = e.kwargs
    if e.type == "expect_column_values_to_not_be_null":
        return F.count_if(F.col(k["column"]).isNull())
    if e.type == "expect_column_values_to_be_unique":
        return F.count(k["column"]) - F.count_distinct(k["column"])
    if e.type == "expect_column_values_to_be_in_set":
        return F.count_if(~F.col(k["column"]).isin(list(k["value_set"])))
    if e.type == "expect_column_values_to_be_between":
        c = F.col(k["column"])
        outside = []
        if k.get("min_value") is not None:
            outside.append(c < _typed(df, k["column"], k["min_value"]))
        if k.get("max_value") is not None:
            outside.append(c > _typed(df, k["column"], k["max_value"]))
        return F.count_if(C.any_of(outside))
    if e.type == "expect_column_values_to_match_regex":
        return F.count_if(~F.col(k["column"]).cast("string").rlike(k["regex"]))
    if e.type.startswith("expect_column_pair_values"):
        a, b = F.col(k["column_A"]), F.col(k["column_B"])
        if e.type.endswith("to_be_equal"):
            return F.count_if(a != b)
        if e.type.endswith("A_to_be_greater_than_or_equal_to_B"):
            return F.count_if(a < b)
        if e.type.endswith("A_to_be_greater_than_B"):
            return F.count_if(a <= b)
    return None


def _row(suite: Suite, i: int, unexpected: Column, success: Column) -> Column:
    e = suite.expectations[i]
    return F.struct(
        F.lit(suite.name).alias("suite"), F.lit(i).alias("position"),
        F.lit(e.type).alias("expectation_type"),
        F.lit(",".join(e.columns) or None).cast("string").alias("column_name"),
        success.alias("success"), unexpected.cast("bigint").alias("unexpected_count"),
    )


def _nothing() -> Column:
    return F.lit(None).cast("bigint")


def run_suite(df: DataFrame, suite: Suite, partition: Mapping[str, object] | None = None) -> DataFrame:
    """One row per expectation. ``partition`` restricts the batch, e.g. to one date."""
    for column, value in (partition or {}).items():
        if column in df.columns:
            df = df.filter(F.col(column) == (F.lit(value) if not isinstance(value, date) else C.day_lit(value)))
    have = set(df.columns)
    passes: dict[bool, list] = {False: [], True: []}
    for i, e in enumerate(suite.expectations):
        if e.type == "expect_table_columns_to_match_ordered_list":
            ok = df.columns == list(e.kwargs["column_list"])
            passes[False].append((i, None, lambda v, ok=ok: F.lit(ok)))
        elif e.type == "expect_table_row_count_to_be_between":
            lo, hi = e.kwargs.get("min_value"), e.kwargs.get("max_value")

            def between(v, lo=lo, hi=hi):
                ok = F.lit(True)
                if lo is not None:
                    ok = ok & (F.col("_total") >= lo)
                if hi is not None:
                    ok = ok & (F.col("_total") <= hi)
                return ok

            passes[False].append((i, None, between))
        else:
            agg = _unexpected(df, e) if set(e.columns) <= have else None
            exact = e.type == "expect_column_values_to_be_unique" and agg is not None
            if agg is None:
                passes[False].append((i, None, lambda v: F.lit(False)))
            else:
                passes[exact].append((i, agg, lambda v: v == 0))
    out = None
    for items in passes.values():
        if not items:
            continue
        aggs = [F.count(F.lit(1)).alias("_total")] + [a.alias(f"_e{i}") for i, a, _ in items if a is not None]
        rows = [
            _row(suite, i, F.col(f"_e{i}") if a is not None else _nothing(),
                 ok(F.col(f"_e{i}") if a is not None else None))
            for i, a, ok in items
        ]
        part = df.agg(*aggs).select(F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    return out


def run_checkpoint(
    validations: Sequence[tuple[str, DataFrame, Suite, Mapping | None]],
) -> DataFrame:
    """Several (table, frame, suite, partition) validations as one result table."""
    out = None
    for table, df, suite, partition in validations:
        part = run_suite(df, suite, partition).withColumn("table_name", F.lit(table))
        out = part if out is None else out.unionByName(part)
    return out
