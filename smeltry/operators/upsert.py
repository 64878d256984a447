"""Merge-like operators as joins and unions, for formats without MERGE or DELETE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smeltry.functions import columns as C
from smeltry.operators import keys as K


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None,
) -> DataFrame:
    """Source rows replace target rows of the same key; other target rows stay.

    ``order`` picks one source row per key first. Rows with a NULL key never
    match and are inserted, as in MERGE.
    """
    if order is not None:
        known = C.all_of([F.col(k).isNotNull() for k in keys])
        source = K.latest_per_key(source.filter(known), keys, order).unionByName(source.filter(~known))
    kept = target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(source.select(*target.columns))


def replace_slice(
    target: DataFrame, fresh: DataFrame, date_col: str, dates: DataFrame | None = None,
) -> DataFrame:
    """Target with the slices named by ``dates`` replaced by ``fresh``.

    ``dates`` defaults to the dates present in ``fresh``; pass it to also empty
    slices that have no fresh rows. Rows without a date are a slice of their own.
    """
    touched = (dates if dates is not None else fresh).select(F.col(date_col).alias("_touched")).distinct()
    kept = target.join(touched, F.col(date_col).eqNullSafe(F.col("_touched")), "left_anti").select(*target.columns)
    return kept.unionByName(fresh.select(*target.columns))


def union_history(batches: Sequence[DataFrame], ingestion_col: str = "ingestion_time") -> DataFrame:
    """All versions of all batches; the ingestion stamp orders them later."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out.filter(F.col(ingestion_col).isNotNull())
