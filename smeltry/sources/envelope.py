"""Parsing of message envelopes (key, value, topic, partition, offset, timestamp).

The same functions serve a Kafka stream, a file stream and a batch of either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smeltry import schemas as S
from smeltry.operators import rows as R


def parse_envelope(df: DataFrame, schema: T.StructType, ts_col: str = "timestamp") -> DataFrame:
    """JSON value to the schema's columns, with the envelope's own columns behind them.

    The document goes through a generator, past which filters are not pushed:
    otherwise each filtered field would parse the document once more. A value
    that is not JSON gives NULL columns.
    """
    document = F.from_json(F.col("value").cast("string"), schema)
    return df.select(
        F.inline(F.array(document)),
        "topic", "partition", "offset", F.col(ts_col).alias("kafka_timestamp"),
    )


def _kafka_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"partition": "kafka_partition", "offset": "kafka_offset"})


def parse_user_events(df: DataFrame) -> DataFrame:
    parsed = _kafka_columns(parse_envelope(df, S.USER_EVENT_MESSAGE)).withColumn(
        "product_id", F.col("metadata")["product_id"]
    )
    return R.require_not_null(
        R.select_schema(parsed, S.RAW_USER_EVENTS), ["event_id", "customer_id", "event_type"]
    )


def parse_marketplace_sales(df: DataFrame) -> DataFrame:
    parsed = _kafka_columns(parse_envelope(df, S.SALE_MESSAGE))
    return R.require_not_null(
        R.select_schema(parsed, S.RAW_MARKETPLACE_SALES),
        ["transaction_id", "product_id", "amount"],
    )
