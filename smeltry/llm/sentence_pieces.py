"""Encoding with a piece model, and decoding.

Null texts count as empty: their ids are the begin and end ids asked for, their
decoded text is empty. Rows keep their other columns' order: only the key and the
results are returned. Repeated rows are encoded each; no row is dropped.
"""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smeltry.llm import piece_bpe
from smeltry.llm.common import table

#: Rows that a worker turns from Arrow into Python objects at once.
AT_ONCE = 500


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def encode(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", bos: bool = True, eos: bool = True, decoded: bool = False) -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit integers) and, if asked for, decoded text."""
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        model = piece_bpe.load(model_file)
        known = piece_bpe.id_table(model)
        head = model.bos.to_bytes(4, "little") if bos else b""
        tail = model.eos.to_bytes(4, "little") if eos else b""
        for part in _slices(batches):
            ids = []
            for x in part.column("text").to_pylist():
                ids.append(b"".join((head, *map(known.__getitem__, piece_bpe.chunks(x or "")), tail)))
                known.keep_small()
            out = [part.column("key"), pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array([model.decode(memoryview(x).cast("I").tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["key", "ids", "decoded"][: len(out)])
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return source.mapInArrow(run, f"key {kind}, ids binary" + ", decoded string" * decoded).withColumnRenamed("key", key)


def decode(df: DataFrame, model_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded text of packed ids; null ids give an empty text."""
    source = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        model = piece_bpe.load(model_file)
        for part in _slices(batches):
            texts = [model.decode(memoryview(x or b"").cast("I").tolist()) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.string())], ["key", "decoded"])

    return source.mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", key)


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 from ids and decoded."""
    return [
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    ]


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return rows.select("doc_id", *digest_columns())
