"""Type-2 history kept in a table: a day's run rewrites current versions only.

The table is partitioned by ``is_current`` and ``closed_in``, the batch that closed a
version ('' while it is current). A run reads the current part, appends the versions it
closes as a partition of their own and then replaces the current part, so its cost
follows the number of keys, not the length of the history.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smeltry.operators import history as H
from smeltry.sources import sinks

LAYOUT = ["is_current", "closed_in"]


def _placed(dim: DataFrame, batch: str) -> DataFrame:
    return dim.withColumn("closed_in", F.when(F.col("is_current"), F.lit("")).otherwise(F.lit(batch)))


def create_history(dim: DataFrame, table: str, batch: str = "initial") -> None:
    """A history table from a dimension's versions; versions closed before stand under ``batch``."""
    _placed(dim, batch).write.format("parquet").partitionBy(*LAYOUT).saveAsTable(table)


def versions(table: DataFrame) -> DataFrame:
    """All versions, without the column of the layout."""
    return table.drop("closed_in")


def apply_snapshot(
    snapshot: DataFrame, table: str, key: str, attrs: Sequence[str], day: date | str, batch: str,
    sk: str = "customer_sk", order: Sequence[Column] | None = None, stamp: datetime | None = None,
) -> bool:
    """Applies a day's snapshot, as ``history.scd2_apply`` does, to a stored history.

    Closed versions are written before the current ones: a run that dies between the two
    leaves the current part as it was, and its replay closes the same versions into the
    same partition. A replay after that finds nothing to change and writes nothing.
    ``batch`` names the run; a batch that closes more later keeps what it closed before.
    Surrogate keys continue above the current ones: a closed version's key is below that
    of its successor. Returns whether anything changed.
    """
    spark = snapshot.sparkSession
    target = spark.table(table)
    before = versions(target.filter("is_current"))
    staging = f"{table}__scd2_{uuid.uuid4().hex}"
    applied = _placed(H.scd2_apply(before, snapshot, key, attrs, day, sk, order, stamp), batch)
    applied.write.format("parquet").partitionBy("is_current").saveAsTable(staging)
    try:
        after = spark.table(staging)
        closed = after.filter("NOT is_current")
        kept = after.filter("is_current")
        n_closed = closed.count()
        if not n_closed and kept.count() == before.count():
            return False
        if n_closed:
            same = target.filter(~F.col("is_current") & (F.col("closed_in") == batch))
            more = same.join(closed.select(sk), sk, "left_anti").select(*closed.columns)
            if more.limit(1).count():  # the partition is read and replaced: through a staging table of its own
                both = f"{staging}_closed"
                closed.unionByName(more).write.format("parquet").saveAsTable(both)
                try:
                    sinks.overwrite_partition(spark.table(both), table, LAYOUT)
                finally:
                    spark.sql(f"DROP TABLE IF EXISTS {both}")
            else:
                sinks.overwrite_partition(closed, table, LAYOUT)
        sinks.overwrite_partition(kept, table, LAYOUT)
        return True
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")
