"""Helpers that several operators share: tables, the shared folder, partition counts."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()

#: Bound of the batches of rows between Spark and its Python workers, where the session sets none.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this library to the Python workers, once for each application, unless they find it anyway."""
    app = spark.sparkContext.applicationId
    here = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [Path.cwd()]
    if app in _shipped or _ROOT in here:
        return
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "smeltry.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((_ROOT / "smeltry").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes for the rest of the session, unless it bounds them itself.

    By Spark's own bounds, 10,000 rows and 64 MB, a batch of texts can have tens of MB,
    of which the JVM and the worker may hold copies.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Every query reads one first, so the workers get the library here."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in `spark.checkpoint.dir`.

    Only where that setting is missing in local mode (tests, a notebook) a temporary
    folder is used; on a cluster no executor would see the driver's.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and not spark.sparkContext.getCheckpointDir():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(n_bytes: int | None, target: int, least: int = 1) -> int:
    """Partitions needed so that none is expected to hold more than `target` bytes."""
    return max(least, math.ceil((n_bytes or 0) / target))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one number."""
    return df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def spread(key: Column, n: int, seed: int = 0) -> Column:
    """Slot 0..n-1 of a key, by hash."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int")
