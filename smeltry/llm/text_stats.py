"""Statistics of a text that quality rules and models use.

Words are runs of anything but the six ASCII white-space characters. Null counts as
a text without words: every statistic is 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smeltry.llm.sentence_pieces import _slices
from smeltry.llm.word_hashes import word_hashes

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
#: Words of a window in which repetition is sought.
WINDOW = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "longest_word"]
_MIX = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 1)], np.uint64)


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    mixed = sum(hashes[k : k + n] * _MIX[k] for k in range(WINDOW))
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    where = np.flatnonzero(np.isin(mixed, twice))
    windows = [tuple(words[i : i + WINDOW]) for i in where]  # equal hashes are checked by the words
    seen = Counter(windows)
    inside = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(where, windows, strict=True):
        if seen[w] > 1:
            inside[i] += 1
            inside[min(i + WINDOW, len(words))] -= 1
    return int((np.cumsum(inside)[:-1] > 0).sum())


def stats_of(text: str | None) -> list[int]:
    text = text or ""
    data = text.encode()
    words, hashes = data.split(), word_hashes(data)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return [
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words, hashes),
        len(text),
        len(lines),
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        sum(map(text.count, "0123456789")),
        sum(map(text.count, ".,;:!?")),
        len(np.unique(hashes)),
        max(map(len, words), default=0),
    ]


def text_stats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the statistics of every row, in one pass over the texts."""
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        for part in _slices(batches):
            rows = [stats_of(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], ["key", *STATS])

    return source.mapInArrow(run, f"key {kind}, " + ", ".join(f"{s} long" for s in STATS)).withColumnRenamed("key", key)


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """`row` (all columns of df, as a struct) beside the statistics of its text; nothing is shuffled."""
    source = df.select(F.struct(*df.columns).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for part in _slices(batches):
            rows = [stats_of(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], ["row", *STATS])

    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(run, f"row {kind}, " + ", ".join(f"{s} long" for s in STATS))
