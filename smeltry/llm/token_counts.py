"""Exact token counts at every prefix of a text.

One pass of prefix dynamic programming (see piece_bpe) gives the count at each
character. The stored counts then answer questions without encoding again: the
total, the count of any prefix, the longest prefix within a budget.

Null and empty texts have the single count 0. Counts are those of encoding the
prefix alone, with the space that the model puts in front, without begin and end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smeltry.llm import piece_bpe
from smeltry.llm.common import table
from smeltry.llm.sentence_pieces import _slices

#: Tokens of one training sequence.
LIMIT = 4096


def counts_at_prefixes(text: str | None, known: piece_bpe.Chunks) -> np.ndarray:
    """Entry i: the number of tokens of text[:i], for i from 0 to its length."""
    parts = [known[x] for x in piece_bpe.chunks(text or "")]
    if not parts:
        return np.zeros(1, np.int32)
    counts = np.frombuffer(b"".join(parts), np.int32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    ends = np.cumsum(sizes)
    before = np.concatenate(([0], np.cumsum(counts[ends - 1])[:-1]))
    counts = counts + np.repeat(before, sizes).astype(np.int32)
    counts[0] = 0  # the space in front of the text alone stands for the empty prefix
    return counts


def prefix_counts(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", limit: int | None = None, stored: bool = True) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, fit_chars and, if `stored`, the counts at every prefix (binary, int32).

    fit_chars is the length of the longest prefix of at most `limit` tokens; null without a limit.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        known = piece_bpe.count_table(piece_bpe.load(model_file))
        for part in _slices(batches):
            total, fit, sizes, kept = [], [], [], []
            for x in part.column("text").to_pylist():
                counts = counts_at_prefixes(x, known)
                total.append(int(counts[-1]))
                sizes.append(len((x or "").encode()))
                fit.append(None if limit is None else len(counts) - 1 - int(np.argmax(counts[::-1] <= limit)))
                if stored:
                    kept.append(counts.tobytes())
                known.keep_small()
            out = [part.column("key"), pa.array(sizes, pa.int64()), pa.array(total, pa.int64()), pa.array(fit, pa.int64())]
            if stored:
                out.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["key", "n_bytes", "n_tokens", "fit_chars", "counts"][: len(out)])

    return source.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, fit_chars long" + ", counts binary" * stored).withColumnRenamed("key", key)


def count_of_prefix(counts: Column, n_chars: Column) -> Column:
    """Tokens of the first n_chars characters, read from stored counts; null beyond the text."""
    packed = F.substring(counts, (n_chars * 4 + 1).cast("int"), F.lit(4))
    digits = F.concat(*[F.hex(F.substring(packed, F.lit(i), F.lit(1))) for i in (4, 3, 2, 1)])
    return F.when(n_chars.between(0, F.octet_length(counts) / 4 - 1), F.conv(digits, 16, 10).cast("long"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = prefix_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=LIMIT)
    counted = counted.withColumn("n_tokens", count_of_prefix(F.col("counts"), (F.octet_length("counts") / 4 - 1).cast("int")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")
