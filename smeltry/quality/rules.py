"""Column rules compiled into aggregates.

A rule is one number over a table and a verdict on it. All simple rules of a
table share one aggregate over one scan. Rules that need exact distinct counts
share a second one, which reads only their key columns, so that the wide first
pass is not repeated for every distinct set. Key sets that hold one another are
reduced in turn instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smeltry.functions import columns as C
from smeltry.operators.keys import near

# --- fixed values -----------------------------------------------------------
NULL_LIMITS = {"critical_fields": 0.0, "important_fields": 0.05, "optional_fields": 0.20}
DUPLICATE_LIMIT = 0.01
COMPLETENESS_LIMIT = 0.05
PATTERN_LIMIT = 0.05
PATTERNS = {
    "email": C.EMAIL, "phone": C.PHONE, "customer_id": C.CUSTOMER_ID, "product_id": C.PRODUCT_ID,
}
# ----------------------------------------------------------------------------

Verdict = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Rule:
    """``value`` is an aggregate; ``verdict(value, total)`` yields its status.

    Rules whose counts add up over slices of a table also name these: ``bad`` rows, and
    ``base`` where the value is their share of it. Rules on the distinct values of
    ``distinct_on`` have no aggregate: ``of_distinct(distinct, total)`` is their value.
    """

    check: str
    column: str
    metric: str
    value: Column | None
    verdict: Verdict
    threshold: float | None = None
    distinct_on: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    condition: str | None = None
    bad: Column | None = None
    base: Column | None = None
    of_distinct: Callable[[Column, Column], Column] | None = None


def _counted(check, column, metric, bad, verdict, threshold, base=None, **more) -> Rule:
    """A rule on a count of rows, or on its share of another count."""
    value = bad if base is None else share(bad, base)
    return Rule(check, column, metric, value, verdict, threshold, bad=bad, base=base, **more)


def _fail_if(bad: Column) -> Column:
    return F.when(bad, F.lit("FAIL")).otherwise(F.lit("PASS"))


def _count_fails(value: Column, total: Column) -> Column:
    return _fail_if(value > 0)


def _empty_warns(status: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit("WARN")).otherwise(status)


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.when(whole != 0, whole), F.lit(0.0))


def null_limit(column: str, level: str = "optional_fields") -> Rule:
    """Share of NULLs against the level's limit: critical fails, others warn."""
    limit = NULL_LIMITS.get(level, 0.20)
    worse = "FAIL" if level == "critical_fields" else "WARN"

    def verdict(value, total):
        return _empty_warns(
            F.when(value > limit, F.lit(worse)).otherwise(F.lit("PASS")), total
        )

    return _counted("nulls", column, "null_percentage", F.count_if(F.col(column).isNull()), verdict, limit, F.count(F.lit(1)), needs=(column,))


def null_count(column: str, limit: float = 0.05) -> Rule:
    return _counted(
        "null_percentage", column, "null_percentage", F.count_if(F.col(column).isNull()),
        lambda v, t: _fail_if(v > limit), limit, F.count(F.lit(1)), needs=(column,),
    )


def completeness(column: str) -> Rule:
    """More than 5 % NULLs fails, any NULL warns, an empty slice warns."""

    def verdict(value, total):
        graded = F.when(value > COMPLETENESS_LIMIT, F.lit("FAIL")).when(value > 0, F.lit("WARN")).otherwise(F.lit("PASS"))
        return _empty_warns(graded, total)

    return _counted(
        "completeness", column, "null_percentage", F.count_if(F.col(column).isNull()), verdict, COMPLETENESS_LIMIT, F.count(F.lit(1)), needs=(column,),
    )


def _distinct(columns: Sequence[str]) -> Column:
    # A struct is never NULL itself, so a NULL key counts as one value.
    return F.count_distinct(F.struct(*columns))


def duplicates(columns: Sequence[str], limit: float = DUPLICATE_LIMIT) -> Rule:
    return Rule(
        "duplicates", "_".join(columns), "duplicate_percentage", None, lambda v, t: _fail_if(v > limit), limit,
        tuple(columns), tuple(columns), of_distinct=lambda n, total: share(total - n, total),
    )


def key_duplicates(columns: Sequence[str]) -> list[Rule]:
    """The whole key set and, when it has several columns, its first column."""
    out = [duplicates(columns)]
    if len(columns) > 1:
        out.append(duplicates(columns[:1]))
    return out


def unique(column: str) -> Rule:
    return Rule(
        "uniqueness", column, "duplicate_count", None, _count_fails, 0.0, (column,), (column,), of_distinct=lambda n, total: total - n,
    )


def value_range(column: str, low=None, high=None) -> list[Rule]:
    """Counts below and above the bounds; text bounds compare as timestamps."""
    c = F.col(column)

    def bound(v):
        return F.lit(v).cast("timestamp") if isinstance(v, str) else F.lit(v)

    def number(v):
        return None if isinstance(v, str) else float(v)

    out = []
    if low is not None:
        out.append(_counted("range", column, "below_minimum", F.count_if(c < bound(low)), _count_fails, number(low), needs=(column,)))
    if high is not None:
        out.append(_counted("range", column, "above_maximum", F.count_if(c > bound(high)), _count_fails, number(high), needs=(column,)))
    return out


def pattern(column: str, regex: str | None = None, kind: str | None = None, limit: float = PATTERN_LIMIT) -> Rule:
    """Share of non-NULL values that do not match; over the limit fails."""
    regex = regex or PATTERNS[kind]
    c = F.col(column)
    return _counted(
        "pattern", column, "violation_percentage", F.count_if(~c.rlike(regex)), lambda v, t: _fail_if(v > limit), limit, F.count(c), needs=(column,),
    )


def business_rule(name: str, condition: str, severity: str = "WARNING") -> Rule:
    """Rows for which the condition is false; an unknown (NULL) result is no violation."""
    worse = "FAIL" if severity == "CRITICAL" else "WARN"
    return _counted(
        "business_rule", name, "violation_count", F.count_if(F.expr(f"NOT ({condition})")),
        lambda v, t: F.when(v > 0, F.lit(worse)).otherwise(F.lit("PASS")), 0.0, condition=condition,
    )


def allowed_values(column: str, values: Sequence) -> Rule:
    return _counted(
        "allowed_values", column, "invalid_count", F.count_if(~F.col(column).isin(list(values))),
        _count_fails, 0.0, needs=(column,),
    )


def result(table: str, rule: Rule, value: Column, total: Column) -> Column:
    return F.struct(
        F.lit(table).alias("table_name"), F.lit(rule.check).alias("check_name"),
        F.lit(rule.column).alias("column_name"), rule.verdict(value, total).alias("status"),
        F.lit(rule.metric).alias("metric"), value.cast("double").alias("observed"),
        F.lit(rule.threshold).cast("double").alias("threshold"),
    )


def _chains(sets: Sequence[tuple[str, ...]]) -> list[list[tuple[str, ...]]]:
    """Key sets in chains, each set in one with a longer one that holds it, if any."""
    out: list[list[tuple[str, ...]]] = []
    for keys in sorted(dict.fromkeys(sets), key=len, reverse=True):
        holding = [chain for chain in out if set(keys) <= set(chain[-1])]
        if holding:
            holding[0].append(keys)
        else:
            out.append([keys])
    return out


def _evaluate_distinct(df: DataFrame, table: str, rules: Sequence[Rule], chain: Sequence[tuple[str, ...]]) -> DataFrame:
    """Rules on key sets each of which holds the next.

    Rows are reduced to the longest set, that to the next and so on, while the rows and
    the sets behind each group are added up. Several distinct counts in one aggregate would
    repeat each row for each set, and a task would hold them all beside what it reads.
    """
    counted = {"_total": F.count(F.lit(1))}
    reduced = df.select(*dict.fromkeys(chain[0]))
    for i, keys in enumerate(chain):
        reduced = near(reduced, keys).groupBy(*dict.fromkeys(keys)).agg(*[c.alias(n) for n, c in counted.items()])
        counted = {n: F.sum(n) for n in counted} | {f"_n{i}": F.count(F.lit(1))}
    counts = reduced.agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in counted.items()])
    total = F.col("_total")
    rows = [result(table, r, r.of_distinct(F.col(f"_n{chain.index(r.distinct_on)}"), total), total) for r in rules if r.distinct_on in chain]
    return counts.select(F.inline(F.array(*rows)))


def _evaluate(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_total")]
    values = [r.value if r.of_distinct is None else r.of_distinct(_distinct(r.distinct_on), F.count(F.lit(1))) for r in rules]
    aggs += [v.alias(f"_v{i}") for i, v in enumerate(values)]
    rows = [result(table, r, F.col(f"_v{i}"), F.col("_total")) for i, r in enumerate(rules)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def resolves(df: DataFrame, condition: str | None) -> bool:
    """Whether the condition can be analysed against the frame; runs no job."""
    if condition is None:
        return True
    try:
        return df.filter(F.expr(condition)).schema is not None
    except AnalysisException:
        return False


def run_rules(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """Result rows of all rules.

    A rule on an absent column, or with a condition Spark cannot resolve, gives
    an ERROR row and leaves the others running.
    """
    have = set(df.columns)
    usable = [r for r in rules if set(r.needs) <= have and resolves(df, r.condition)]
    absent = [r for r in rules if not any(r is u for u in usable)]
    parts = []
    simple = [r for r in usable if not r.distinct_on]
    exact = [r for r in usable if r.distinct_on]
    if simple:
        parts.append(_evaluate(df, table, simple))
    chains = _chains([r.distinct_on for r in exact])
    if len(chains) == 1:
        parts.append(_evaluate_distinct(df, table, exact, chains[0]))
    elif exact:
        parts.append(_evaluate(df, table, exact))
    if absent:
        rows = [(table, r.check, r.column, "ERROR", r.metric, None, r.threshold) for r in absent]
        parts.append(_literal_rows(df, rows))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _literal_rows(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    from smeltry.schemas import CHECK_RESULT

    return df.sparkSession.createDataFrame(list(rows), CHECK_RESULT)


def rules_from_config(config: Mapping, columns: Sequence[str] = ()) -> list[Rule]:
    """Rules of a table from its configuration.

    Keys: ``null_rules`` {column: level} (``columns`` it does not name are held to
    the optional level), ``non_null_columns``, ``key_columns``,
    ``unique_columns``, ``range_checks`` {column: {min_value|min_date, max_value|
    max_date}}, ``pattern_rules`` {column: {pattern|type, threshold}},
    ``business_rules`` [{name, condition, severity}], ``valid_values`` {column: [..]}.
    """
    out: list[Rule] = []
    if "null_rules" in config:
        levels = {c: "optional_fields" for c in columns} | dict(config["null_rules"])
        out += [null_limit(c, level) for c, level in levels.items()]
    for column in config.get("non_null_columns", []):
        out.append(completeness(column))
    if config.get("key_columns"):
        out += key_duplicates(config["key_columns"])
    for column in config.get("unique_columns", []):
        out.append(unique(column))
    for column, r in config.get("range_checks", {}).items():
        low = r.get("min_value", r.get("min_date", r.get("min")))
        high = r.get("max_value", r.get("max_date", r.get("max")))
        out += value_range(column, low, high)
    for column, r in config.get("pattern_rules", {}).items():
        out.append(pattern(column, r.get("pattern"), r.get("type"), r.get("threshold", PATTERN_LIMIT)))
    rules = config.get("business_rules", [])
    if not isinstance(rules, Mapping):
        for r in rules:
            if r.get("condition"):
                out.append(business_rule(r.get("name", "unnamed_rule"), r["condition"], r.get("severity", "WARNING")))
    for column, values in config.get("valid_values", {}).items():
        out.append(allowed_values(column, values))
    return out
