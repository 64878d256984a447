"""Rows with a usable vector, and vectors packed in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, *more: Column, zero: bool = True) -> DataFrame:
    """key (long), v (array<double>) and more columns of the rows that take part.

    Those are rows with a key and a vector without null or non-finite components, of the
    length that most such rows have (of equally many the shorter), and not zero unless
    `zero`. Rows of one key count once: the first by vector and more columns.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"), *more)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("key").isNotNull() & finite)
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").select("d").first()
    rows = rows.where(F.size("v") == (length[0] if length else 0))
    first = F.row_number().over(Window.partitionBy("key").orderBy("v", *[c for c in rows.columns if c not in ("key", "v")]))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def packed(df: DataFrame, size: int, *groups: str, kinds: dict[str, str]) -> DataFrame:
    """Rows in blocks of about `size`: block, n and each column of `kinds` as one binary value.

    kinds gives a column's numpy type; a column of arrays is packed item after item. With
    `groups` no block holds rows of two groups, and those columns stay beside the block.
    Blocks are dealt by the key's hash, so a group of any size is spread evenly.
    """
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"))
    n = 0 if groups else (counts.first() or [0])[0]
    placed = df.join(counts, list(groups)) if groups else df.withColumn("_rows", F.lit(n))
    blocks = F.ceil(F.col("_rows") / size).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key", F.lit(17)), blocks).cast("int"))
    # so many partitions as blocks, as what follows works on a block for long
    dealt = placed.repartition(*groups, "block") if groups else placed.repartition(max(1, -(-n // size)), "block")
    return _blocks(dealt.sortWithinPartitions(*groups, "block", "key"), [*groups, "block"], kinds)


def cut(df: DataFrame, size: int, group: str, order: str, kinds: dict[str, str]) -> DataFrame:
    """Rows of each group, by `order` and key, in blocks of at most `size` rows: group, n and the columns of `kinds` as in `packed`."""
    return _blocks(df.repartition(group).sortWithinPartitions(group, order, "key"), [group], kinds, size)


def _blocks(rows: DataFrame, own: list[str], kinds: dict[str, str], most: int | None = None) -> DataFrame:
    """Rows that follow each other with the same `own` columns as one, or as several of at most `most` rows."""
    names = list(kinds)
    source = rows.select(*own, *names)

    def run(batches):
        held: list[list[np.ndarray]] = []
        label = None

        def row():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            values = [*label, n, *(c.tobytes() for c in columns)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [*types, pa.int32(), *[pa.binary()] * len(names)], strict=True)], [*own, "n", *names])

        n, types = 0, None
        for batch in batches:
            types = [batch.schema.field(c).type for c in own]
            marks = list(zip(*(batch.column(c).to_pylist() for c in own), strict=True))
            at = 0
            while at < len(marks):
                if label is not None and (marks[at] != label or n == most):
                    yield row()
                    held, n = [], 0
                label = marks[at]
                end = at + 1
                while end < len(marks) and marks[end] == label and (most is None or n + end - at < most):
                    end += 1
                held.append([_flat(batch.column(c).slice(at, end - at), kinds[c]) for c in names])
                n += end - at
                at = end
        if held:
            yield row()

    fields = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"{c} {fields[c]}" for c in own), "n int", *(f"{c} binary" for c in names)]))


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    if pa.types.is_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).astype(kind)
