"""Type-2 history: applying snapshots, reading a day, checking intervals.

A version is valid from ``effective_start_date`` up to, not including,
``effective_end_date``; the open end is 9999-12-31.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from smeltry.functions import columns as C
from smeltry.operators import keys as K

CUSTOMER_ATTRIBUTES = ("customer_name", "email", "address", "city", "country", "membership_tier")


def scd2_apply(
    dim: DataFrame, snapshot: DataFrame, key: str, attrs: Sequence[str], day: date | str,
    sk: str = "customer_sk", order: Sequence[Column] | None = None, stamp: datetime | None = None,
) -> DataFrame:
    """The dimension after applying a day's snapshot; every earlier row is kept.

    New keys and keys with a changed attribute get a version starting on
    ``day``; the replaced version is closed on ``day``. Keys absent from the
    snapshot and unchanged keys stay as they are, so a re-run changes nothing.
    Several snapshot rows of a key are reduced to the first under ``order``.
    """
    now = (F.lit(stamp) if stamp is not None else F.current_timestamp()).cast("timestamp")
    survivors = list(order or []) + [F.col(a).asc_nulls_last() for a in attrs]
    latest = K.latest_per_key(
        snapshot.filter(F.col(key).isNotNull()), [key], survivors
    ).select(key, *attrs)

    current = dim.filter("is_current").select(
        F.col(key).alias("_key"), *[F.col(a).alias(f"_c_{a}") for a in attrs]
    )
    changed = C.any_of([C.differs(F.col(a), F.col(f"_c_{a}")) for a in attrs])
    fresh = (
        latest.join(current, F.col(key) == F.col("_key"), "left")
        .filter(F.col("_key").isNull() | changed)
        .select(key, *attrs)
    )

    replaced = fresh.select(F.col(key).alias("_replaced"))
    closes = F.col("_replaced").isNotNull()
    kept = dim.join(
        replaced, (F.col(key) == F.col("_replaced")) & F.col("is_current"), "left"
    ).withColumns(
        {
            "effective_end_date": F.when(closes, C.day_lit(day)).otherwise(F.col("effective_end_date")),
            "is_current": F.col("is_current") & ~closes,
            "updated_time": F.when(closes, now).otherwise(F.col("updated_time")),
        }
    ).drop("_replaced")

    last_sk = dim.agg(F.coalesce(F.max(sk), F.lit(0)).alias("m")).scalar()
    added = K.spread_index(fresh, key, sk, start=last_sk).withColumns(
        {
            "effective_start_date": C.day_lit(day),
            "effective_end_date": F.lit(C.OPEN_END),
            "is_current": F.lit(True),
            "created_time": now,
            "updated_time": now,
        }
    )
    return kept.unionByName(added.select(*dim.columns))


def as_of(dim: DataFrame, day: date | str) -> DataFrame:
    """The versions valid on a day."""
    d = C.day_lit(day)
    return dim.filter(
        (F.col("effective_start_date") <= d)
        & (F.coalesce(F.col("effective_end_date"), F.lit(C.OPEN_END)) > d)
    )


def interval_breaks(dim: DataFrame, key: str, sk: str) -> DataFrame:
    """One row: counts of overlapping and of non-adjoining consecutive versions.

    Versions are compared inside (key, start month), then the months of a key
    are stitched by their outer rows, so one window group holds a month of a
    key rather than its whole history.
    """
    d = dim.select(
        key,
        F.col(sk).alias("_sk"),
        F.col("effective_start_date").alias("_start"),
        F.coalesce(F.col("effective_end_date"), F.lit(C.OPEN_END)).alias("_end"),
        F.date_trunc("month", "effective_start_date").cast("date").alias("_month"),
    )
    inside = d.withColumn(
        "_next",
        F.lead("_start").over(W.partitionBy(key, "_month").orderBy("_start", "_end", "_sk")),
    ).select("_end", "_next")
    months = d.groupBy(key, "_month").agg(
        F.min("_start").alias("_start"),
        F.max_by("_end", F.struct("_start", "_end", "_sk")).alias("_end"),
    )
    across = months.withColumn(
        "_next", F.lead("_start").over(W.partitionBy(key).orderBy("_month"))
    ).select("_end", "_next")
    return inside.unionByName(across).agg(
        F.count_if(F.col("_next") < F.col("_end")).alias("overlaps"),
        F.count_if(F.col("_next") > F.col("_end")).alias("gaps"),
    )
