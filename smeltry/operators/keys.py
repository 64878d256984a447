"""Deduplication, latest-version and numbering operators.

Each stays balanced when one key owns a large share of the rows:

* ``latest_per_key`` filters a ``row_number`` to 1, which Spark turns into a
  group limit *before* the shuffle, so a task ships at most one row per key.
* ``spread_index`` numbers rows without a single-task window.
* ``row_number_in_steps`` ranks inside huge groups, one step of the order at a time,
  ``row_number_in_ranges`` by ranges of the order itself, so ties may be of any size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order``, which should be total.

    NULL keys form one group each, as in ``dropDuplicates``. The key's hash leads
    the partitioning: text keys often share a long prefix, and sorting on the
    hash settles nearly all comparisons in one word.
    """
    w = W.partitionBy("_hash", *keys).orderBy(*order)
    return (
        near(df, keys).withColumn("_hash", F.xxhash64(*keys))
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .drop("_rn", "_hash")
    )


def near(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, those of a key mostly together, in partitions of AQE's advisory size.

    A map-side aggregate or group limit holds every distinct key that its task reads. Over a
    join or a large file split this comes on top of their own memory, and grows with them
    when few keys repeat; behind this it is bounded by the advisory size. AQE splits a hot
    key's partition, so the caller must still combine by key. Without AQE nothing changes.
    """
    return df.withColumn("_near", F.xxhash64(*keys, F.lit("near"))).hint("rebalance", "_near").drop("_near")


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """``dropDuplicates`` with a defined survivor.

    Without ``order`` the survivor is the smallest row by all other columns, so
    the result does not depend on how the input was partitioned. Columns that
    hold maps, which have no order, are compared by their JSON text.
    """
    if order is None:
        order = [
            (F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name)).asc_nulls_last()
            for f in df.schema.fields if f.name not in keys
        ] or [F.lit(1)]
    return latest_per_key(df, keys, order)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, limited before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def distinct_sample(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """The ``n`` smallest distinct value combinations."""
    return df.select(*columns).distinct().orderBy(*columns).limit(n)


def duplicate_groups(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Keys held by several rows, with count and first and last ``ts``.

    Members are not collected into an array, which would put a hot key's rows
    in one value; see ``duplicate_members``.
    """
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("duplicate_count"),
            F.max(ts).alias("latest_ingestion"),
            F.min(ts).alias("earliest_ingestion"),
        )
        .filter("duplicate_count > 1")
    )


def duplicate_members(df: DataFrame, keys: Sequence[str], member: str, ts: str) -> DataFrame:
    """Every member of a duplicated key as its own row, with the group's figures."""
    groups = duplicate_groups(df, keys, ts).withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    return df.join(groups, same, "inner").select(
        *keys, member, "duplicate_count", "latest_ingestion", "earliest_ingestion"
    )


def duplicate_key_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys occur more than once."""
    return (
        df.groupBy(*keys).count().filter("count > 1")
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
    )


def spread_index(df: DataFrame, key: str, out: str, start: Column | int = 0, hex_digits: int = 3) -> DataFrame:
    """Unique, repeatable numbers above ``start`` for rows with distinct keys.

    Rows fall into ``16**hex_digits`` slots by the MD5 of their key; a row gets
    ``start + 1 + slot + slots * (position in slot)``. Every slot is its own
    window group, so numbering is spread over the cluster, needs one shuffle,
    and depends on the keys only. Numbers may leave gaps.
    """
    slots = 16 ** hex_digits
    digest = F.md5(F.col(key).cast("binary"))
    slot = F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")
    w = W.partitionBy("_slot").orderBy("_digest", key)
    start_col = start if isinstance(start, Column) else F.lit(start)
    number = (
        start_col.cast("bigint") + 1 + F.col("_slot")
        + F.lit(slots).cast("bigint") * (F.row_number().over(w) - 1)
    )
    return (
        df.withColumns({"_slot": slot, "_digest": digest})
        .withColumn(out, number)
        .drop("_slot", "_digest")
    )


def row_number_in_steps(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], step: Column, out: str,
) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order)`` for groups of any size.

    A window would put a whole group into one task. ``step`` is a coarse value
    that never falls under ``order`` (a price in whole dollars, a day): rows are
    numbered inside (keys, step), and shifted by the rows of earlier steps,
    which are counted map-side. So a task holds one step of a group. ``order``
    must be total.
    """
    stepped = df.withColumn("_step", step)
    counts = stepped.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_step").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_step").alias("_k_step"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
    )
    numbered = stepped.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_step").orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return (
        numbered.join(shifts, [F.col("_step").eqNullSafe(F.col("_k_step")), *same], "inner")
        .withColumn(out, (F.col("_rn") + F.col("_shift")).cast("bigint"))
        .select(*df.columns, out)
    )


#: Slots of the sample that ranges are cut from, for each range.
SAMPLE_SLOTS = 16


def row_number_in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, ranges: int = 256) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order)`` for groups and ties of any size.

    ``order`` is ascending with NULL first, and total inside a group (negate a number,
    lead with ``isNull`` for another order). Splitters are cut from a sample of
    (keys, order) that takes one row of each hash slot: a bounded number, and the same
    for every reading of the rows. Rows are numbered inside (keys, range) and shifted
    by the prefix sums of the ranges' counts, which are combined map-side. A range
    holds about ``1 / ranges`` of all rows, whatever they have in common.
    """
    ranged = in_ranges(df, keys, order, ranges)
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k_range"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
    )
    numbered = ranged.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return (
        numbered.join(shifts, [F.col("_range") == F.col("_k_range"), *same], "inner")
        .withColumn(out, (F.col("_rn") + F.col("_shift")).cast("bigint"))
        .select(*df.columns, out)
    )


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ranges: int = 256) -> DataFrame:
    """``_range`` of every row: how many splitters of the sample are not above its (keys, order)."""
    fine = math.isqrt(ranges - 1) + 1  # ranges in each coarse one
    place = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[c.alias(f"o{i}") for i, c in enumerate(order)])
    placed = df.withColumn("_place", place)
    slot = F.pmod(F.xxhash64("_place"), F.lit(SAMPLE_SLOTS * ranges))
    sample = placed.groupBy(slot.alias("_slot")).agg(F.min_by("_place", F.xxhash64("_place", F.lit(1))).alias("p"))
    cuts = sample.agg(F.array_sort(F.collect_list("p")).alias("p"))
    each = F.greatest(F.lit(1), F.floor(F.size("p") / ranges)).cast("int")
    cuts = cuts.select(F.filter("p", lambda x, i: i % each == each - 1).alias("p"))
    # in two levels: a row is compared with the first cuts of the coarse ranges, then inside one
    levels = cuts.select(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("p")), F.lit(fine)), lambda i: F.slice("p", i, F.lit(fine))).alias("p"))
    placed = placed.withColumn("_cuts", levels.scalar())
    coarse = F.size(F.filter("_cuts", lambda some: some[0] <= F.col("_place")))
    inner = F.size(F.filter(F.get("_cuts", coarse - 1), lambda p: p <= F.col("_place")))
    return placed.withColumn("_range", F.when(coarse > 0, (coarse - 1) * fine + inner).otherwise(0)).drop("_place", "_cuts")
