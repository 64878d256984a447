"""Kafka source options and reader. The connector package comes with the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Upper bound of offsets per micro-batch, by preset.
OFFSETS_PER_TRIGGER = {"unbounded": None, "standard": 1000, "bulk": 10000}


# Where a first start begins, and whether offsets that expired stop the stream. `tail`
# takes what is new and goes on over gaps; `complete` loses nothing silently.
START = {"complete": ("earliest", True), "tail": ("latest", False)}


def kafka_options(servers: str, topic: str, preset: str = "unbounded", start: str = "complete") -> dict[str, str]:
    starting, fail = START[start]
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": str(fail).lower(),
    }
    limit = OFFSETS_PER_TRIGGER[preset]
    if limit is not None:
        options["maxOffsetsPerTrigger"] = str(limit)
    return options


def read_kafka(
    spark: SparkSession, servers: str, topic: str, preset: str = "unbounded", start: str = "complete",
) -> DataFrame:
    return spark.readStream.format("kafka").options(
        **kafka_options(servers, topic, preset, start)
    ).load()
