"""Exact distinct counts that can be stored by slice and merged: bitmaps over numbered keys.

Keys get small numbers once. A slice's bitmaps hold one bit a key, 32,768 to a bitmap,
so a day of a million visitors is some 120 kB, whatever the number of their events, and
the visitors of a month are the union of thirty days' bitmaps: no event is read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smeltry.operators import keys as K


def number_keys(df: DataFrame, key: str, known: DataFrame | None = None, out: str = "number", hex_digits: int = 3) -> DataFrame:
    """(key, number) of the distinct keys of ``df``, which are text.

    Keys of ``known`` keep their number; new ones get numbers above all of those, so
    bitmaps stored before stay valid. NULL has no number. Numbers spread over
    ``16**hex_digits`` slots: take fewer digits where a batch brings fewer new keys.
    """
    distinct = df.select(key).filter(F.col(key).isNotNull()).distinct()
    if known is None:
        return K.spread_index(distinct, key, out, hex_digits=hex_digits)
    new = distinct.join(known.select(key), key, "left_anti")
    last = known.agg(F.coalesce(F.max(out), F.lit(0)).alias("m")).scalar()
    return known.select(key, out).unionByName(K.spread_index(new, key, out, start=last, hex_digits=hex_digits))


def key_bitmaps(df: DataFrame, groups: Sequence[str], number: str = "number") -> DataFrame:
    """groups, bucket, bitmap: which numbers each group holds. Built map-side; NULL numbers count for nothing."""
    n = F.col(number)
    return (
        df.filter(n.isNotNull()).groupBy(*groups, F.bitmap_bucket_number(n).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bitmap"))
    )


def merge_bitmaps(bitmaps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Union of bitmaps by coarser groups."""
    return bitmaps.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_totals(bitmaps: DataFrame, groups: Sequence[str], out: str) -> DataFrame:
    """Distinct keys of each group. Bitmaps must be merged to these groups."""
    return bitmaps.groupBy(*groups).agg(F.sum(F.bitmap_count("bitmap")).alias(out))
