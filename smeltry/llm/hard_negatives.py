"""Hard negatives for contrastive training, by a vertical scan with bounds.

Vectors become integers, scores are exact integer inner products. Rows are stored in
blocks dimension by dimension, with the least and greatest value of each. An anchor
reads a block's dimensions in the order of its own components' magnitude. After each
few dimensions the partial score of every candidate is known, and least and greatest
values bound what the remaining ones can add; candidates that can't matter leave the
bitmap, and the next dimensions are read for the others only. In the end scores are exact.

The first scan keeps candidates of the anchor's label that may be among its best few:
its positives. Each positive opens a window of scores, between two shares of its own;
the second scan keeps candidates of other labels that may be among the best of a window.
Both meet anchors with rows block by block, so a task holds one block of rows and a few of
anchors, and what leaves a block is a few rows an anchor. Blocks of both are stored once and
read where they meet; nothing is repeated in a shuffle or sent to the driver. Ties go to
the smaller key.

Rows without a key, label or vector, with null or non-finite components, or with a
vector of another length than most, take no part, nor do components so large that a
score could leave 64 bits. Repeated keys count once, the first by vector and label.
Anchors without positives give no rows; an empty table gives an empty result.
Other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smeltry.llm.common import small_batches, table, written
from smeltry.llm.vectors import packed, usable

#: Rows, and anchors, of a block.
ROWS, ANCHORS = 8192, 256
#: Dimensions read between two prunings.
STEP = 8

Useful = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Block:
    """A block of rows by dimension. Values are doubles where every score is exact in them."""

    def __init__(self, keys: bytes, labels: bytes, v: bytes, dim: int):
        self.keys, self.labels = np.frombuffer(keys, np.int64), np.frombuffer(labels, np.int64)
        dims = np.frombuffer(v, np.int64).reshape(-1, dim).T
        self.low, self.high = dims.min(axis=1), dims.max(axis=1)
        largest = int(np.abs(dims).max(initial=0))
        self.largest = largest
        self.whole = np.ascontiguousarray(dims)
        self.real = self.whole.astype(np.float64) if largest < 1 << 26 else None

    def scan(self, a: np.ndarray, bitmap: np.ndarray, useful: Useful) -> tuple[np.ndarray, np.ndarray]:
        """Rows left in the bitmap and their scores, after dimensions in the order of |a|."""
        order = np.argsort(-np.abs(a), kind="stable")
        a, low, high = a[order], self.low[order], self.high[order]
        # what the dimensions from each on can add
        least = np.append(np.minimum(a * low, a * high)[::-1].cumsum()[::-1], 0)
        most = np.append(np.maximum(a * low, a * high)[::-1].cumsum()[::-1], 0)
        exact = self.real is not None and int(np.abs(a).max(initial=0)) * self.largest * max(1, len(a)) < 1 << 53
        dims = self.real if exact else self.whole
        weights = a.astype(dims.dtype)
        alive = np.flatnonzero(bitmap)
        total = np.zeros(len(alive), dims.dtype)
        for at in range(0, len(a), STEP):
            if not len(alive):
                break
            end = min(at + STEP, len(a))
            if 2 * len(alive) < dims.shape[1]:
                total += weights[at:end] @ dims[order[at:end, None], alive]
            else:  # cheaper than to pick most of the rows out first
                part = weights[at:end] @ dims[order[at:end]]
                total += part if len(alive) == len(part) else part[alive]
            if end < len(a) and total.max() - total.min() < most[end] - least[end]:
                continue  # the bounds of any two candidates still overlap
            keep = useful(total + least[end], total + most[end])
            if not keep.all():
                alive, total = alive[keep], total[keep]
        return alive, total.astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(key, score) of the first k, ties by key."""
        if len(rows) > k:
            some = scores >= np.partition(scores, -k)[-k]
            rows, scores = rows[some], scores[some]
        keys = self.keys[rows]
        first = np.lexsort((keys, -scores))[:k]
        return list(zip(keys[first].tolist(), scores[first].tolist(), strict=True))


def among_best(k: int) -> Useful:
    """Candidates whose greatest score reaches the k-th of the least scores."""

    def useful(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return most >= np.partition(least, -k)[-k] if len(least) > k else np.ones(len(least), bool)

    return useful


def in_windows(windows: list[tuple[int, int]], k: int) -> Useful:
    """Candidates that may be among the k best scores of one of the windows (both bounds included)."""

    def useful(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(least), bool)
        for low, high in windows:
            inside = least[(least >= low) & (most <= high)]
            floor = max(low, np.partition(inside, -k)[-k]) if len(inside) >= k else low
            keep |= (most >= floor) & (least <= high)
        return keep

    return useful


def _scanned(rows: DataFrame, anchors: DataFrame, dim: int, found, schema: str) -> DataFrame:
    """`found(block, key, label, vector, extra)` for every anchor and block of rows; it gives tuples."""
    # a stated set of anchors against all rows: each block of anchors meets each block of rows once.
    # By the hint neither side is broadcast, as Spark would do by its guess of a block's size.
    asked = written(anchors.select(*[F.col(c).alias(f"a_{c}") for c in ("key", "label", "v", "extra")]))
    cells = rows.select("key", "label", "v").hint("shuffle_replicate_nl").crossJoin(asked)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                block = Block(c["key"], c["label"], c["v"], dim)
                keys, labels = (np.frombuffer(c[f"a_{n}"], np.int64).tolist() for n in ("key", "label"))
                vectors = np.frombuffer(c["a_v"], np.int64).reshape(-1, dim)
                extra = np.frombuffer(c["a_extra"], np.int64).reshape(len(keys), -1).tolist()
                out = [x for row in zip(keys, labels, vectors, extra, strict=True) for x in found(block, *row)]
                columns = list(zip(*out, strict=True)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return cells.mapInArrow(run, schema)


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k first rows of each group by score, ties by key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "key"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, is_anchor: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Components become floor(scale * x). `is_anchor` takes the key column; labels are
    integers. A negative's score lies between `low` and `high` percent of the positive's.
    """
    small_batches(df.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    rows = usable(df, key, vector, label.cast("long").alias("label")).where("label IS NOT NULL")
    rows = written(rows)
    head = rows.select(F.size("v")).first()
    dim = max(1, head[0] if head else 1)
    bound = math.isqrt(((1 << 63) - 1) // dim) - 1
    whole = F.transform("v", lambda x: F.floor(x * scale))
    rows = rows.where(F.forall("v", lambda x: F.abs(x * scale) < bound)).select("key", "label", whole.alias("v"), F.expr("array_repeat(0L, 0)").alias("extra"))
    kinds = {"key": "<i8", "label": "<i8", "v": "<i8"}
    stored = written(packed(rows, ROWS, kinds=kinds))
    anchors = rows.where(is_anchor(F.col("key")))

    def best_positives(block, own, label, v, _):
        rows, scores = block.scan(v, (block.labels == label) & (block.keys != own), among_best(positives))
        return [(own, k, s) for k, s in block.best(rows, scores, positives)]

    with_extra = kinds | {"extra": "<i8"}
    found = _scanned(stored, packed(anchors, ANCHORS, kinds=with_extra), dim, best_positives, "own long, key long, score long")
    mine = written(_first(found, ["own"], positives).select("own", F.col("key").alias("positive"), F.col("score").alias("p"), "rank"))
    # the positives' keys, then their scores, beside each anchor
    at = lambda c: [F.max(F.when(F.col("rank") == r, F.col(c))) for r in range(1, positives + 1)]
    beside = mine.groupBy("own").agg(F.array(F.count(F.lit(1)), *[F.coalesce(x, F.lit(0)) for x in [*at("positive"), *at("p")]]).alias("beside"))
    anchors = anchors.join(beside, F.col("key") == F.col("own")).select("key", "label", "v", F.col("beside").alias("extra"))

    def best_negatives(block, own, label, v, extra):
        some = range(extra[0])
        windows = [(-(-low * extra[1 + positives + i] // 100), high * extra[1 + positives + i] // 100) for i in some]
        open_ = [w for w in windows if w[0] <= w[1]]
        if not open_:
            return []
        rows, scores = block.scan(v, block.labels != label, in_windows(open_, negatives))
        out = []
        for i, (lo, hi) in enumerate(windows):
            inside = (scores >= lo) & (scores <= hi)
            out += [(own, extra[1 + i], extra[1 + positives + i], k, s) for k, s in block.best(rows[inside], scores[inside], negatives)]
        return out

    found = _scanned(stored, packed(anchors, ANCHORS, kinds=with_extra), dim, best_negatives, "own long, positive long, p long, key long, score long")
    return _first(found, ["own", "positive"], negatives).select(
        F.col("own").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"),
        F.col("p").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), lambda k: k % 50 == 0, label=moved)
