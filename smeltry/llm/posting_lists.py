"""Nearest neighbours by inner product from balanced posting lists.

Vectors are lifted by one component, the root of the largest squared norm less their own,
so that the largest inner product is the smallest distance. A bounded sample is cut into
equal parts again and again, along the line between two means; the parts' means are
the centroids, and a list belongs to each. A graph over the centroids, in the memory of
every worker, links each to its nearest, to the next in the order of the cuts and to a
few far ones. It is searched from a few entries: whatever lies within a ratio of the
nearest distance found so far is followed.

Every vector goes to the list of its nearest centroid, and vectors near a boundary go to
the next lists as well, at most COPIES in all. A query reads the lists whose centroid's
distance is within a ratio of the nearest one's; the ratio is the least with which COVER
of the neighbours of sampled queries are in a list that is read. Lists that follow each
other in the order of the cuts form a part. A query goes once to each part of which it
reads a list, with a bit for each list of the part, so its vector isn't sent once for each
list. A part's rows are stored by list in blocks of bounded size.

Of rows with equal vectors, the first k + 1 by key are kept in lists: no other can be in
an answer. Scores are sums of products in double precision, in the order of components;
ties go to the smaller key. A sample of stored rows gives each query k first neighbours,
and only rows that reach the worst of them leave a list.

Rows without a key or vector, with null or non-finite components, zero vectors and those
of another length than most take no part. Repeated keys count once, the first by vector.
With fewer candidates than k all are returned; an empty table gives an empty result.
Other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smeltry.llm.common import small_batches, table, written
from smeltry.llm.vectors import cut, usable

#: Rows and bytes of the sample that centroids are fitted on, at most.
SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
#: Rows for each list, and lists at most.
LIST_ROWS, LISTS = 128, 8192
#: Lists that hold a vector, at most, and how much farther than the nearest they may be.
COPIES, NEAR = 3, 1.05
#: Share of the sampled queries' neighbours that the lists read must hold.
COVER = 0.97
#: Sampled queries; stored rows that give a query its first neighbours, one of SEED_SHARE, and their bytes at most.
TRIALS, SEEDS, SEED_SHARE, SEED_BYTES = 400, 16_384, 4, 16 << 20
#: Rows and queries in a block, at most.
ROWS, QUERIES = 4096, 1024
#: Parts that the lists form: so many, more where a part would get more rows than this, fewer if there are fewer lists.
PARTS, PART_ROWS = 32, 65_536
#: Links of a centroid to near and to far ones; entries of a search; centroids followed at least.
NEAREST, FAR, ENTRIES, FOLLOW = 14, 4, 16, 8
#: Vectors that are looked up in the graph at once; bytes of the vectors whose distances are taken at once.
AT_ONCE, GATHERED = 128, 4 << 20


@dataclass
class Index:
    """Centroids with their graph, and how they were fitted. Its size is bounded by LISTS."""

    centroids: np.ndarray
    links: np.ndarray
    norm2: float
    ratio: float = math.inf

    def lift(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, self.norm2 - (v * v).sum(axis=1)))
        return np.column_stack((v, rest))

    def distances(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances of lifted vectors to the centroids that the graph search meets; infinite to others."""
        n, k = len(x), len(self.centroids)
        out = np.full((n, k), np.inf)
        expanded = np.zeros((n, k), bool)

        def meet(flat: np.ndarray) -> None:
            most = max(1, GATHERED // (8 * x.shape[1]))
            for some in (flat[at : at + most] for at in range(0, len(flat), most)):
                q, c = np.divmod(some, k)
                out.flat[some] = np.sqrt(((x[q] - self.centroids[c]) ** 2).sum(axis=1))

        entries = np.unique(np.linspace(0, k - 1, min(k, ENTRIES)).astype(np.int64))
        meet((np.arange(n)[:, None] * k + entries).ravel())
        follow = min(FOLLOW, k) - 1
        while True:
            bound = np.maximum(out.min(axis=1) * ratio, np.partition(out, follow, axis=1)[:, follow])
            q, c = np.nonzero((out <= bound[:, None]) & ~expanded & np.isfinite(out))
            if not len(q):
                return out
            expanded[q, c] = True
            flat = np.unique((q[:, None] * k + self.links[c]).ravel())
            meet(flat[np.isinf(out.flat[flat])])

    def lists_of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for the lists that hold each vector: the nearest, and others near a boundary."""
        rows, lists = [], []
        for at in range(0, len(v), AT_ONCE):
            d = self.distances(self.lift(v[at : at + AT_ONCE]), NEAR)
            some = min(COPIES, d.shape[1])
            order = np.argpartition(d, some - 1, axis=1)[:, :some] if some < d.shape[1] else np.argsort(d, axis=1)
            near = np.take_along_axis(d, order, axis=1)
            q, k = np.nonzero(near <= near.min(axis=1, keepdims=True) * NEAR)
            rows.append(q + at)
            lists.append(order[q, k])
        return np.concatenate(rows), np.concatenate(lists)

    def read_by(self, q: np.ndarray) -> np.ndarray:
        """Whether each query reads each list: those within the ratio of the nearest."""
        reads = np.ones((len(q), len(self.centroids)), bool)
        for at in range(0, len(q) if math.isfinite(self.ratio) else 0, AT_ONCE):
            d = self.distances(self.lift(q[at : at + AT_ONCE], query=True), self.ratio)
            reads[at : at + AT_ONCE] = d <= d.min(axis=1, keepdims=True) * min(self.ratio, 1e300)
        return reads


def balanced(x: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Row numbers of so many parts of nearly equal size, each cut along the line between two means."""
    out: list[np.ndarray] = []
    todo = [(np.arange(len(x)), parts)]
    while todo:
        rows, n = todo.pop()
        if n == 1 or len(rows) < 2:
            out.append(rows)
            continue
        some = x[rows if len(rows) <= 2048 else rng.choice(rows, 2048, replace=False)]
        a, b = some[rng.choice(len(some), 2, replace=False)]
        for _ in range(6):
            nearer = ((some - a) ** 2).sum(axis=1) <= ((some - b) ** 2).sum(axis=1)
            if nearer.all() or not nearer.any():
                break
            a, b = some[nearer].mean(axis=0), some[~nearer].mean(axis=0)
        left = n // 2
        cut = min(max(1, round(len(rows) * left / n)), len(rows) - 1)
        order = np.argpartition(x[rows] @ (b - a), cut - 1)
        todo += [(rows[order[cut:]], n - left), (rows[order[:cut]], left)]
    return out


def graph(centroids: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Links of each centroid: its nearest, its neighbours in the order of the cuts, and far ones."""
    k = len(centroids)
    near = min(NEAREST, k)
    links = np.empty((k, near + 2 + FAR), np.int64)
    square = (centroids * centroids).sum(axis=1)
    for at in range(0, k, 1024):
        d = square - 2 * (centroids[at : at + 1024] @ centroids.T)
        links[at : at + 1024, :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
    links[:, near] = (np.arange(k) + 1) % k
    links[:, near + 1] = (np.arange(k) - 1) % k
    links[:, near + 2 :] = rng.integers(0, k, (k, FAR))
    return links


def fit(sample: np.ndarray, norm2: float, rows: int, k: int) -> Index:
    """An index fitted on a sample of so many rows, its ratio on neighbours within the sample."""
    rng = np.random.default_rng(7)
    # no more lists than the sample gives some rows each
    parts = max(1, min(LISTS, math.ceil(rows / LIST_ROWS), len(sample) // 8))
    index = Index(np.zeros((1, 1)), np.zeros((1, 1), np.int64), norm2)
    lifted = index.lift(sample)
    index.centroids = np.array([lifted[r].mean(axis=0) for r in balanced(lifted, parts, rng)])
    index.links = graph(index.centroids, rng)
    if len(sample) < 8 * (k + 1):
        return index  # a few lists, all of which are read
    trials = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    best = np.empty((len(trials), k), np.int64)
    for at in range(0, len(trials), 16):
        some = trials[at : at + 16]
        far = -(sample[some] @ sample.T)
        far[np.arange(len(some)), some] = np.inf
        best[at : at + 16] = np.argpartition(far, k - 1, axis=1)[:, :k]
    found, place = np.unique(best, return_inverse=True)
    row, holds = index.lists_of(sample[found])
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))  # rows ascend
    x = index.lift(sample[trials], query=True)
    d = np.concatenate([index.distances(x[at : at + 16], math.inf) for at in range(0, len(x), 16)])
    place = place.reshape(best.shape)
    # the distance to the nearest list that holds the neighbour
    needed = np.array([np.minimum.reduceat(d[i, holds], first)[place[i]] for i in range(len(trials))])
    nearest = d.min(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratios = np.where(needed <= nearest, 1.0, needed / nearest)
    index.ratio = float(np.quantile(ratios, COVER, method="higher"))
    return index


def best_of(own: np.ndarray, q: np.ndarray, floor: np.ndarray, keys: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows but its own that reach its floor, by query and rank.

    Rows are chosen by a product of matrices, with some slack for its rounding; scores are
    then summed in the order of components.
    """
    out = []
    columns = np.ascontiguousarray(v.T)
    for at in range(0, len(q), AT_ONCE):
        part = np.ascontiguousarray(q[at : at + AT_ONCE].T)
        rough = part.T @ columns
        slack = 1e-9 * max(1.0, float(rough.max(initial=0)), -float(rough.min(initial=0)))
        near = (rough >= floor[at : at + AT_ONCE, None] - slack) & (keys != own[at : at + AT_ONCE, None])
        many = np.flatnonzero(near.sum(axis=1) > k)
        if len(many):
            some = np.where(near[many], rough[many], -np.inf)
            near[many] &= some >= np.partition(some, -k, axis=1)[:, [-k]] - slack
        i, row = np.nonzero(near)
        score = np.zeros(len(i))
        for x, y in zip(part, columns, strict=True):
            score += x[i] * y[row]
        order = np.lexsort((keys[row], -score, i))
        i = i[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[first] + at, row[order][first], score[order][first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Asked:
    """A block of queries at a part: the k best rows found for each so far, and the floor that they set."""

    def __init__(self, own: np.ndarray, q: np.ndarray, floor: np.ndarray, reads: np.ndarray, k: int):
        self.own, self.q, self.floor, self.reads, self.k = own, q, floor.copy(), reads, k
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def meet(self, lists: np.ndarray, keys: np.ndarray, v: np.ndarray) -> None:
        """Rows by list, which are numbered within the part."""
        more = [self.found]
        starts = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
        for at, end in zip(starts, np.append(starts[1:], len(lists)), strict=True):
            some = np.flatnonzero(self.reads[:, lists[at]])
            if len(some):
                i, row, score = best_of(self.own[some], self.q[some], self.floor[some], keys[at:end], v[at:end], self.k)
                more.append((some[i], keys[at:end][row], score))
        i, key, score = (np.concatenate(c) for c in zip(*more, strict=True))
        order = np.lexsort((key, -score, i))
        i, key, score = i[order], key[order], score[order]
        # a row of several lists is found once in each, with the same score
        once = np.append(True, (i[1:] != i[:-1]) | (key[1:] != key[:-1]))[: len(i)]
        i, key, score = i[once], key[once], score[once]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        last = rank == self.k - 1
        self.floor[i[last]] = np.maximum(self.floor[i[last]], score[last])
        self.found = i[rank < self.k], key[rank < self.k], score[rank < self.k]

    def rows(self) -> pa.RecordBatch:
        i, key, score = self.found
        return _found(self.own[i], key, score)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sampled(rows: DataFrame, n: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of about `most` rows, by the hash of their key: keys are distinct, so the number is near it."""
    share = min(1.0, most / max(1, n))
    slots = 1 << 30
    some = rows.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(slots)) < math.ceil(share * slots)).select("key", "v").toArrow()
    v = some.column("v").combine_chunks()
    dim = len(v[0]) if len(v) else 1
    keys = some.column("key").to_numpy()
    order = np.argsort(keys)
    return keys[order], _matrix(v, dim)[order]


def neighbours(df: DataFrame, is_query: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for each query row.

    `is_query` takes the key column.
    """
    small_batches(df.sparkSession)
    kind, of = ("<f4", "float") if df.schema[vector].dataType.simpleString() == "array<float>" else ("<f8", "double")
    rows = written(usable(df, key, vector, zero=False))
    copy = F.row_number().over(Window.partitionBy("v").orderBy("key"))
    kept = written(rows.withColumn("_copy", copy).where(F.col("_copy") <= k + 1).drop("_copy"))
    n, norm2, dim = kept.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.size("v"))).first()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(_sampled(kept, n, min(SAMPLE, SAMPLE_BYTES // (8 * dim)), 5)[1], norm2, n, k)
    seed_keys, seeds = _sampled(kept, n, min(SEEDS, SEED_BYTES // (8 * dim), math.ceil(n / SEED_SHARE)), 6)

    lists = len(index.centroids)
    per = math.ceil(lists / min(lists, max(PARTS, math.ceil(COPIES * n / PART_ROWS))))  # lists of a part

    def in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), dim)
                row, own = index.lists_of(v)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * dim), pa.array(v[row].astype(kind).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array((own // per).astype(np.int32)), pa.array((own % per).astype(np.int32)), batch.column("key").take(pa.array(row)), vectors], ["part", "list", "key", "v"])

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(at, QUERIES) for at in range(0, batch.num_rows, QUERIES)):
                q, own = _matrix(some.column("v"), dim), some.column("key").to_numpy()
                floor = np.full(len(q), -np.inf)
                if len(seeds) > k:
                    i, _, score = best_of(own, q, floor, seed_keys, seeds, k)
                    floor[i] = score  # in the order of ranks: the last is the k-th
                reads = index.read_by(q)
                for part in range(0, lists, per):
                    here = np.flatnonzero(reads[:, part : part + per].any(axis=1))
                    if len(here):
                        values = own[here], q[here].astype(kind), floor[here], np.packbits(reads[here, part : part + per], axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array([part // per], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in values)], ["part", "own", "q", "floor", "reads"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, own = _matrix(batch.column("v"), dim), batch.column("key").to_numpy()
            query, row, score = best_of(own, q, np.full(len(q), -np.inf), seed_keys, seeds, k)
            yield _found(own[query], seed_keys[row], score)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                value = lambda c, kind: np.frombuffer(batch.column(c)[at].as_buffer(), kind)  # noqa: B023, E731
                own = value("own", np.int64)
                if block != (mark := (batch.column("part")[at].as_py(), int(own[0]))):  # a query is in one block of a part
                    if asked:
                        yield asked.rows()
                    reads = np.unpackbits(value("reads", np.uint8).reshape(len(own), -1), axis=1).astype(bool)
                    block, asked = mark, Asked(own.copy(), value("q", kind).reshape(-1, dim).astype(np.float64), value("floor", np.float64), reads, k)
                asked.meet(value("list", np.int32), value("key", np.int64), value("v", kind).reshape(-1, dim).astype(np.float64))
        if asked:
            yield asked.rows()

    queries = rows.where(is_query(F.col("key")))
    stored = cut(kept.mapInArrow(in_lists, f"part int, list int, key long, v array<{of}>"), ROWS, "part", "list", kinds={"list": "<i4", "key": "<i8", "v": kind})
    asked = queries.mapInArrow(asks, "part int, own binary, q binary, floor binary, reads binary")
    # queries lead: a block of them meets the blocks of its part one after another
    cells = asked.join(stored, "part")
    shape = "query_id long, vec_id long, score double"
    found = cells.mapInArrow(scored, shape).union(queries.mapInArrow(first, shape))
    # a neighbour is found once in each part that holds it
    found = found.repartition("query_id").dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(query: np.ndarray, key: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(key), pa.array(score)], ["query_id", "vec_id", "score"])


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (query_id, vec_id) that were found."""
    n = exact.count()
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0


def op11_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), lambda k: k % 20 == 0)
