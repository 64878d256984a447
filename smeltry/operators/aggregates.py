"""Aggregations used by the layers. All combine map-side before their shuffle."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count_within(condition: Column, days_ago: Column, days: int) -> Column:
    return F.count_if(condition & (days_ago <= days))


def null_tallies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


QUARTILES = {"q1": 0.25, "q3": 0.75}


def quantiles(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000, probs: Mapping[str, float] = QUARTILES) -> DataFrame:
    """One row with ``{column}_{name}`` for each probability, all in one pass.

    Ranks are within 1 / ``accuracy`` of the rows. One sketch serves all
    probabilities of a column; its size depends on ``accuracy`` alone.
    """
    sketches = df.agg(*[F.percentile_approx(c, list(probs.values()), accuracy).alias(c) for c in columns])
    return sketches.select(*[F.get(c, F.lit(k)).alias(f"{c}_{n}") for c in columns for k, n in enumerate(probs)])


#: Distinct values of a bracket that are ranked in one window group.
BRACKET_VALUES = 100_000


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], accuracy: int = 10_000, probs: Mapping[str, float] = QUARTILES, at_most: int = BRACKET_VALUES,
) -> DataFrame:
    """``quantiles`` without error, at any size: the smallest value whose rank reaches the share.

    Each quantile is bracketed by two approximate ones. A pass then counts the rows
    below and inside each bracket, and its distinct values. While a bracket has more
    than ``at_most`` of those, the next round takes approximate quantiles inside it,
    which leaves about 4 in ``accuracy`` of its rows. What is inside in the end is
    counted by value map-side and ranked. The rounds run when this is called, each
    giving one row of a few numbers: a third round is needed from some 10^12 distinct
    values on. Columns without values give NULL.
    """
    slots = [_Bracket(c, n, p) for c in columns for n, p in probs.items()]
    sizes = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    for s in slots:
        s.rank = max(1, math.ceil(sizes[list(columns).index(s.column)] * s.share))
        s.rows = sizes[list(columns).index(s.column)]
    open_ = [s for s in slots if s.rows]
    while open_:
        parts = [F.percentile_approx(F.when(s.inside(), F.col(s.column)), F.lit(s.around(accuracy)), F.lit(accuracy)).alias(f"q{i}") for i, s in enumerate(open_)]
        near = df.agg(*parts).first()
        before = [(s.low, s.high) for s in open_]
        for i, s in enumerate(open_):
            s.low, s.high = (F.lit(v).cast(df.schema[s.column].dataType) for v in near[f"q{i}"])
        counted = []
        for i, s in enumerate(open_):
            c, within = F.col(s.column), s.inside()
            counted += [F.count_if(c < s.low).alias(f"b{i}"), F.count_if(within).alias(f"r{i}"), F.approx_count_distinct(F.when(within, c)).alias(f"d{i}")]
        found = df.agg(*counted).first()
        still = []
        for i, s in enumerate(open_):
            stuck = before[i][0] is not None and s.rows == found[f"r{i}"]
            s.below, s.rows = found[f"b{i}"], found[f"r{i}"]
            if found[f"d{i}"] > at_most and not stuck:
                still.append(s)
        open_ = still
    return _ranked(df, slots)


class _Bracket:
    """Two values of a column between which a quantile lies, with the rows below and inside."""

    def __init__(self, column: str, name: str, share: float):
        self.column, self.name, self.share = column, name, share
        self.low: Column | None = None
        self.high: Column | None = None
        self.rank = self.rows = self.below = 0

    def inside(self) -> Column:
        c = F.col(self.column)
        return c.isNotNull() if self.low is None else c.between(self.low, self.high)

    def around(self, accuracy: int) -> list[float]:
        """Shares of the bracket's rows on both sides of the quantile."""
        at = (self.rank - self.below) / self.rows
        return [min(1.0, max(0.0, at + d)) for d in (-2.0 / accuracy, 2.0 / accuracy)]


def _ranked(df: DataFrame, slots: Sequence[_Bracket]) -> DataFrame:
    known = [s for s in slots if s.low is not None]
    columns = {s.column: df.schema[s.column].dataType for s in slots}
    if not known:
        return df.sparkSession.range(1).select(*[F.lit(None).cast(columns[s.column]).alias(f"{s.column}_{s.name}") for s in slots])
    kinds = list(dict.fromkeys(columns[s.column] for s in known))
    values = [f"v{k}" for k in range(len(kinds))]  # a value stands in the column of its type

    def row(i: int, s: _Bracket) -> Column:
        return F.struct(F.lit(i).alias("slot"), *[
            (F.when(s.inside(), F.col(s.column)) if kind == columns[s.column] else F.lit(None).cast(kind)).alias(v) for v, kind in zip(values, kinds, strict=True)
        ])

    near = df.select(F.inline(F.array(*[row(i, s) for i, s in enumerate(known)]))).filter(" OR ".join(f"{v} IS NOT NULL" for v in values))
    near = near.groupBy("slot", *values).agg(F.count(F.lit(1)).alias("rows"))
    upto = near.withColumn("upto", F.sum("rows").over(W.partitionBy("slot").orderBy(*values)))
    place = {(s.column, s.name): i for i, s in enumerate(known)}
    aggs = []
    for s in slots:
        i, kind = place.get((s.column, s.name)), columns[s.column]
        hit = F.lit(None).cast(kind) if i is None else F.when((F.col("slot") == i) & (F.col("upto") >= s.rank - s.below), F.col(values[kinds.index(kind)]))
        aggs.append(F.min(hit).alias(f"{s.column}_{s.name}"))
    return upto.agg(*aggs)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Typed count, mean, stddev, min and max, one row per column."""
    parts = []
    for c in columns:
        v = F.col(c).cast("double")
        parts.append(
            F.struct(
                F.lit(c).alias("column_name"), F.count(c).alias("count"), F.avg(v).alias("mean"),
                F.stddev(v).alias("stddev"), F.min(v).alias("min"), F.max(v).alias("max"),
            )
        )
    return df.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


#: Correlations in one aggregate: more would outgrow generated code.
PAIRS_AT_ONCE = 32


def correlations(
    df: DataFrame, columns: Sequence[str] | None = None, above: float = 0.5, digits: int = 4,
) -> DataFrame:
    """Column pairs with |Pearson r| above the bound, from one pass over the rows.

    Few pairs are aggregates of their own. Many come from ``comoments``, whose work a
    row is a product of small matrices; no row is multiplied. Rows with a NULL in a
    pair do not count for it.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    pairs = list(combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")
    if len(pairs) <= PAIRS_AT_ONCE:
        wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_r{k}") for k, (a, b) in enumerate(pairs)])
        rows = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"_r{k}").alias("r")) for k, (a, b) in enumerate(pairs)]
        # one row of a few numbers becomes a row for each pair
        out = wide.select(F.inline(F.array(*rows)))
    else:
        n, x, y, xx, yy, xy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
        spread = (xx - x * x / n) * (yy - y * y / n)
        out = comoments(df, cols).select("column_a", "column_b", F.when((n > 1) & (spread > 0), (xy - x * y / n) / F.sqrt(spread)).alias("r"))
    return out.filter(F.abs("r") > above).withColumn("r", F.round("r", digits))


def comoments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_a, column_b, n, sx, sy, sxx, syy, sxy: for each pair, sums over the rows that have both.

    One pass: with NULL as 0, the product of (values, presence, squares) with itself holds
    every pair's sums at once, for a batch of rows. A task adds up its batches and sends a
    row for each pair. Values are taken less a pivot, the mean of a few rows, so that
    large values with a small spread lose no digits; r does not depend on it.
    """
    cols = list(columns)
    k = len(cols)
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    some = values.limit(1000).agg(*[F.avg(f"c{i}") for i in range(k)]).first()
    pivot = np.array([p if p is not None and math.isfinite(p) else 0.0 for p in some])
    one, two = np.triu_indices(k, 1)

    def sums(batches):
        total = np.zeros((6, len(one)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - pivot
            m = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            odd = ~(np.isfinite(x) | (m == 0)).all(axis=1)  # NaN and infinity must reach their own pairs only
            x[m == 0] = 0.0
            for rows in (~odd, odd):
                a, p = x[rows], m[rows]
                if rows is odd and len(a):
                    with np.errstate(invalid="ignore"):
                        both = p[:, one] * p[:, two] > 0
                        u, v = np.where(both, a[:, one], 0.0), np.where(both, a[:, two], 0.0)
                        total += np.array([w.sum(axis=0) for w in (both, u, v, u * u, v * v, u * v)])
                elif len(a):
                    total += np.array([g[i, j] for g, i, j in ((p.T @ p, one, two), (a.T @ p, one, two), (a.T @ p, two, one), ((a * a).T @ p, one, two), ((a * a).T @ p, two, one), (a.T @ a, one, two))])
        yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), *map(pa.array, total)], ["i", "j", *SUMS])

    parts = values.mapInArrow(sums, ", ".join(["i int", "j int", *(f"{s} double" for s in SUMS)]))
    names = F.array(*[F.lit(c) for c in cols])
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS]).select(
        F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"), *SUMS
    )


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def share_of_group(df: DataFrame, group: Sequence[str], value: str, out: str, digits: int = 4) -> DataFrame:
    """value / group total, for frames already aggregated to few rows per group."""
    total = F.sum(value).over(W.partitionBy(*group))
    return df.withColumn(
        out, F.round(F.when(total != 0, F.col(value).cast("double") / total), digits)
    )


def share_of_group_max(
    df: DataFrame, group: str, value: str, out: str, digits: int = 4,
) -> DataFrame:
    """value / largest value of its group, 0 where that is 0.

    The maximum is aggregated map-side and joined back, so a large group is not
    gathered in one task.
    """
    top = df.groupBy(F.col(group).alias("_g")).agg(F.max(value).alias("_top"))
    share = F.when(F.col("_top") > 0, F.col(value).cast("double") / F.col("_top")).otherwise(F.lit(0.0))
    return (
        df.join(top, F.col(group) == F.col("_g"), "inner")
        .withColumn(out, F.round(share, digits))
        .drop("_g", "_top")
    )


def version_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("versions")).orderBy(F.desc("versions"), key)


def metrics_by(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in metrics.items()])
