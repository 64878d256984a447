"""Session presets.

Only settings that change results or plan shape are listed; everything else is
left at Spark's defaults. Executor sizing belongs to the cluster that submits
the job.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job wants: UTC wall clock, AQE with skew handling that may add
# a shuffle when it pays, and partition overwrite that leaves other slices alone.
COMMON = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "snappy",
    # The default, INT96, has no row-group statistics: times would not be pruned by.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

PRESETS = {
    "local": {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    },
    # Development works on samples of real tables: enough partitions to see skew.
    "development": {"spark.sql.shuffle.partitions": "50"},
    # Tests run on fixtures of a few rows, where each task costs more than its rows.
    "testing": {"spark.sql.shuffle.partitions": "10"},
    # AQE coalesces down from the initial number, so start wide: a partition
    # must fit in memory at 100 TB, small jobs shrink on their own.
    "production": {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
        "spark.sql.files.maxPartitionBytes": "256MB",
    },
    "batch": {
        "spark.sql.files.maxPartitionBytes": "128MB",
        "spark.sql.shuffle.partitions": "200",
    },
    "streaming": {
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        # Sessions of a hot key are merged before the shuffle.
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.streaming.stopGracefullyOnShutdown": "true",
        "spark.sql.streaming.metricsEnabled": "true",
    },
    "statistics": {
        "spark.sql.cbo.enabled": "true",
        "spark.sql.cbo.joinReorder.enabled": "true",
        "spark.sql.statistics.histogram.enabled": "true",
    },
}


def settings(*presets: str) -> dict[str, str]:
    """Merged settings of the named presets, later ones winning."""
    merged = dict(COMMON)
    for name in presets:
        merged.update(PRESETS[name])
    return merged


def builder(app_name: str, *presets: str) -> SparkSession.Builder:
    """A session builder with the presets applied; the caller sets the master."""
    b = SparkSession.builder.appName(app_name)
    for key, value in settings(*presets).items():
        b = b.config(key, value)
    return b
