"""File readers and the day-slice scan."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smeltry import schemas as S
from smeltry.functions import columns as C
from smeltry.operators import rows as R


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents of multi-line JSON array files, with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_campaigns(spark: SparkSession, path: str, ingested: datetime | None = None) -> DataFrame:
    """Campaign documents as bronze rows; ``ingested`` overrides their stamp."""
    df = read_json_array(spark, path, S.CAMPAIGN_DOCUMENT)
    if ingested is not None:
        df = df.withColumn("ingestion_time", F.lit(ingested))
    return R.select_schema(df, S.RAW_MARKETING_CAMPAIGNS)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return R.select_schema(read_json_array(spark, path, S.PRODUCT_DOCUMENT), S.RAW_PRODUCT_CATALOG)


def read_events_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Envelope files as a stream: the file-based twin of the Kafka source."""
    reader = spark.readStream.schema(S.KAFKA_ENVELOPE).format(fmt)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def scan_slice(
    df: DataFrame, ts: str, day: date | str | None, also: str | None = None, partition: str | None = None,
) -> DataFrame:
    """Rows of one day by ``ts``, or by ``also`` as a second time; all rows for None.

    ``partition`` is a day column derived from ``ts`` by which the files are
    laid out: other days' folders are then not read. It says nothing about
    ``also``, so the two exclude each other.
    """
    if day is None:
        return df
    keep = C.on_day(ts, day)
    if also is not None:
        if partition is not None:
            raise ValueError("a partition by the first time would lose rows of the second")
        keep = keep | C.on_day(also, day)
    if partition is not None:
        keep = keep & (F.col(partition) == C.day_lit(day))
    return df.filter(keep)
