"""Writers: these, and only these, start jobs."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from smeltry.operators import rows as R
from smeltry.operators import upsert as U


def _aligned(df: DataFrame, table: str) -> DataFrame:
    return R.select_schema(df, df.sparkSession.table(table).schema)


def append(df: DataFrame, table: str) -> None:
    """Append by name: columns are aligned to the table before the positional insert."""
    _aligned(df, table).write.mode("append").insertInto(table)


def stream_append(
    df: DataFrame, path: str, checkpoint: str, every: str | None = None,
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Append a stream to parquet files. Without ``every``, drain what is there and stop."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start(path)


def overwrite_partition(df: DataFrame, table: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``.

    Inserts take the overwrite mode from the session only, where writers that run
    side by side would race in changing it. So it must be dynamic already, as in
    every preset of ``session.py``. Rows are rebalanced by partition value first:
    each value goes to few files, and AQE splits a value that is large.
    """
    if df.sparkSession.conf.get("spark.sql.sources.partitionOverwriteMode").lower() != "dynamic":
        raise ValueError("set spark.sql.sources.partitionOverwriteMode to dynamic: static would replace all partitions")
    frame = _aligned(df, table).hint("rebalance", *[F.col(c) for c in partition_by])
    frame.write.mode("overwrite").insertInto(table)


def overwrite_table(df: DataFrame, table: str) -> None:
    """Full refresh through a staging table, safe when ``df`` reads ``table``."""
    spark = df.sparkSession
    staging, old = f"{table}__staging", f"{table}__old"
    spark.sql(f"DROP TABLE IF EXISTS {staging}")
    df.write.format("parquet").saveAsTable(staging)
    if spark.catalog.tableExists(table):
        spark.sql(f"DROP TABLE IF EXISTS {old}")
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def create_from_dataframe(
    df: DataFrame, table: str, partition_cols: Sequence[str] = (), properties: Mapping[str, str] | None = None,
) -> list[str]:
    """Create an empty parquet table with the frame's schema, if it does not exist.

    A partition column whose name says date or time and whose type is a
    timestamp is replaced by a derived ``{name}_day`` date column. Returns the
    partition columns used; ``with_day_columns`` fills them before a write.
    """
    shaped = with_day_columns(df, partition_cols)
    parts = [_day_name(df, c) for c in partition_cols]
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        writer = shaped.limit(0).write.format("parquet")
        for k, v in (properties or {}).items():
            writer = writer.option(k, v)
        if parts:
            writer = writer.partitionBy(*parts)
        writer.saveAsTable(table)
    return parts


def _day_name(df: DataFrame, column: str) -> str:
    timed = ("date" in column.lower() or "time" in column.lower()) and dict(df.dtypes)[column].startswith("timestamp")
    return f"{column}_day" if timed else column


def with_day_columns(df: DataFrame, partition_cols: Sequence[str]) -> DataFrame:
    new = {
        _day_name(df, c): F.to_date(c) for c in partition_cols if _day_name(df, c) != c
    }
    return df.withColumns(new) if new else df


def in_slices(table: DataFrame, column: str, slices: DataFrame) -> DataFrame:
    """Rows of the table whose ``column`` is in ``slices``, NULL included.

    The bounds of the slices go into the filter as literals, so partitions
    outside them are not listed, let alone read.
    """
    low, high, has_null = slices.agg(F.min(column), F.max(column), F.bool_or(F.col(column).isNull())).first()
    bounds = F.lit(False) if low is None else F.col(column).between(F.lit(low), F.lit(high))
    if has_null:
        bounds = bounds | F.col(column).isNull()
    wanted = slices.select(F.col(column).alias("_slice"))
    return table.filter(bounds).join(wanted, F.col(column).eqNullSafe(F.col("_slice")), "left_semi")


def replace_slices_in_table(fresh: DataFrame, table: str, partition_by: str, dates: DataFrame | None = None) -> None:
    """Rewrite the slices that ``fresh`` covers; with ``dates``, also drop those of them it leaves empty.

    ``dates`` are the touched slices, in a column named like the partition; as many
    come to the driver as become empty.
    """
    if dates is None:
        overwrite_partition(fresh, table, [partition_by])
        return
    # read twice, for its slices and its rows: staged, so that it is computed once
    spark = fresh.sparkSession
    staging = f"{table}__slices_{uuid.uuid4().hex}"
    fresh.write.format("parquet").saveAsTable(staging)
    try:
        staged = spark.table(staging)
        left = staged.select(F.col(partition_by).alias("_fresh")).distinct()
        gone = dates.select(partition_by).distinct().join(left, F.col(partition_by).eqNullSafe(F.col("_fresh")), "left_anti")
        values = [None if r[0] is None else str(r[0]) for r in gone.collect()]
        overwrite_partition(staged, table, [partition_by])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")
    for value in values:
        literal = "null" if value is None else "'" + value.replace("'", "\\'") + "'"
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({partition_by} = {literal})")


def upsert_table(source: DataFrame, table: str, keys: Sequence[str], partition_by: str, order=None) -> None:
    """Upsert into a partitioned table, reading and rewriting only touched slices.

    Requires that a key never moves between partitions (an event keeps its event
    date). The slices, that of rows without a partition value among them, are
    staged before the overwrite, because a table cannot be overwritten while it
    is read. Staging tables have names of their own.
    """
    spark = source.sparkSession
    target = spark.table(table)
    slices = in_slices(target, partition_by, source.select(partition_by).distinct())
    merged = U.upsert(slices, R.select_schema(source, target.schema), keys, order)
    staging = f"{table}__merge_{uuid.uuid4().hex}"
    merged.write.format("parquet").saveAsTable(staging)
    try:
        overwrite_partition(spark.table(staging), table, [partition_by])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")


def file_sizes(df: DataFrame) -> DataFrame:
    """Path and size of every file behind a scan, from a listing: no file is opened."""
    spark, paths = df.sparkSession, df.inputFiles()
    folders = sorted({p.rsplit("/", 1)[0] for p in paths})
    if not folders:
        return spark.createDataFrame([], "file_path string, file_size long")
    listed = spark.read.format("binaryFile").load(folders)
    return listed.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"))


def compact(spark: SparkSession, path: str, out: str, target_bytes: int = 256 * 1024 * 1024, partition_by: Sequence[str] = ()) -> int:
    """Rewrite a parquet folder to ``out`` in files of about ``target_bytes``.

    Returns the number of write partitions. The input is left untouched.
    """
    df = spark.read.parquet(path)
    total = file_sizes(df).agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / target_bytes))
    if partition_by:
        spread = df.hint("rebalance", n, *[F.col(c) for c in partition_by])
        spread.write.mode("errorifexists").partitionBy(*partition_by).parquet(out)
    else:
        df.repartition(n).write.mode("errorifexists").parquet(out)
    return n
