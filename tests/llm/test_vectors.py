"""Vector operators against brute force."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from smeltry.llm import hard_negatives as H
from smeltry.llm import posting_lists as P

SHAPE = "vec_id long, embedding array<float>, label int, v string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, lab, "clash", 1) for k, v, lab in rows], SHAPE).repartition(4)


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows):
    """op12 by its rules, on (vec_id, vector, label) with distinct ids and vectors of one length."""
    rows = [(k, [math.floor(256 * float(np.float32(x))) for x in v], (lab + 1) % 10 if k % 7 == 0 else lab) for k, v, lab in rows if lab is not None and finite(v)]
    out = []
    for k, a, lab in rows:
        if k % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), j, other) for j, v, other in rows if j != k)
        for s, j, _ in [x for x in scored if x[2] == lab][:5]:
            p = -s
            inside = [(-m, i) for m, i, other in scored if other != lab and 50 * p <= -100 * m <= 95 * p]
            out += [(k, j, r, i, p, m) for r, (m, i) in enumerate(inside[:3], 1)]
    return sorted(out)


def given(sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    return list(zip(t["vec_id"], t["embedding"], t["label"], strict=True))


@pytest.fixture(scope="module")
def odd():
    """Many ties, nulls, zeros and values of very different size."""
    rnd = random.Random(8)
    rows = [(k, [rnd.choice((-0.5, 0.0, 0.25, 0.5, 1.0)) for _ in range(6)], rnd.randrange(3)) for k in range(600)]
    rows += [(k, [0.5, 0.25, 0.5, 0.0, 1.0, 0.25], 1) for k in range(600, 800)]
    rows += [(800, None, 1), (801, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (802, [1.0, math.nan, 0.0, 0.0, 0.0, 0.0], 1), (803, [math.inf] + [0.0] * 5, 2)]
    rows += [(850, [1.0] * 6, None), (900, [0.0] * 6, 1), (950, [900.0, -700.0, 0.0, 3.5, 1e4, 2.0], 1), (951, [800.0, 1.0, 2.0, 3.0, 9e3, 2.0], 2)]
    return rows


def negatives(spark, rows):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = H.hard_negatives(frame(spark, rows), lambda k: k % 50 == 0, label=moved)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_equal_brute_force(spark, sf, odd, monkeypatch):
    for rows in (given(sf), odd):
        want = brute_negatives(rows)
        assert len(want) > 50
        for n, m in ((8192, 256), (64, 3)):
            monkeypatch.setattr(H, "ROWS", n)
            monkeypatch.setattr(H, "ANCHORS", m)
            assert negatives(spark, rows) == want


def test_hard_negatives_of_repeated_rows_and_nothing(spark, odd):
    want = brute_negatives(odd)
    assert negatives(spark, odd + odd[:300] + [(None, [1.0] * 6, 1), (5, [1.0, 2.0], 1)]) == want
    assert negatives(spark, []) == [] and negatives(spark, [(50, [1.0], 1)]) == []


def test_no_block_is_broadcast(spark, odd, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 64)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = H.hard_negatives(frame(spark, odd), lambda k: k % 50 == 0, label=moved)
    assert out.count() == len(brute_negatives(odd))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_pruning_leaves_what_a_full_scan_finds():
    rnd = np.random.default_rng(2)
    v = rnd.integers(-200, 200, (500, 32)).astype(np.int64)
    v[:, 20:] //= 40  # small values: bounds soon decide
    block = H.Block(np.arange(500).tobytes(), np.zeros(500, np.int64).tobytes(), v.tobytes(), 32)
    a = v[7] * np.concatenate((np.full(8, 9), np.ones(24, np.int64)))
    scores = v @ a
    rows, found = block.scan(a, np.ones(500, bool), H.among_best(5))
    assert len(rows) < 500 and block.best(rows, found, 5) == sorted(zip(range(500), scores.tolist()), key=lambda x: (-x[1], x[0]))[:5]
    windows = [(-300, 4000), (10**5, 2 * 10**5)]
    rows, found = block.scan(a, np.ones(500, bool), H.in_windows(windows, 3))
    for lo, hi in windows:
        inside = (found >= lo) & (found <= hi)
        assert block.best(rows[inside], found[inside], 3) == sorted(((k, s) for k, s in enumerate(scores.tolist()) if lo <= s <= hi), key=lambda x: (-x[1], x[0]))[:3]


def test_large_values_stay_exact():
    v = np.array([[2**30, 3], [2**30, 4], [-(2**30), 2**30]], np.int64)
    block = H.Block(np.arange(3).tobytes(), np.zeros(3, np.int64).tobytes(), v.tobytes(), 2)
    rows, scores = block.scan(np.array([2**30, 1]), np.ones(3, bool), H.among_best(3))
    assert dict(zip(rows.tolist(), scores.tolist())) == {0: 2**60 + 3, 1: 2**60 + 4, 2: -(2**60) + 2**30}


def dot(x, y):
    """In the order of components; sum() would compensate rounding."""
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


def brute_neighbours(rows, every=20, k=20):
    """{query: [(key, score)]} by all inner products, on distinct ids."""
    rows = [(j, [float(np.float32(x)) for x in v]) for j, v, _ in rows if finite(v) and any(v)]
    out = {}
    for j, q in rows:
        if j % every == 0:
            out[j] = sorted(((i, dot(q, v)) for i, v in rows if i != j), key=lambda r: (-r[1], r[0]))[:k]
    return out


def found(spark, rows, **more):
    out: dict = {}
    for r in sorted(P.neighbours(frame(spark, rows), lambda j: j % 20 == 0, **more).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def share(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_neighbours_are_found_and_scores_exact(spark, size):
    rows = given(f"/root/testdata/{size}")
    want, got = brute_neighbours(rows), found(spark, rows)
    assert got.keys() == want.keys() and share(got, want) >= 0.9
    vectors = {j: [float(np.float32(x)) for x in v] for j, v, _ in rows}
    for q, some in got.items():
        assert len(some) == 20 and len({i for i, _ in some}) == 20
        assert some == sorted(some, key=lambda r: (-r[1], r[0]))
        assert all(s == dot(vectors[q], vectors[i]) for i, s in some)


def clustered(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(40, dim)) * 3
    x = means[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * rng.uniform(0.2, 2, (n, 1))
    return [(k, v.tolist(), 1) for k, v in enumerate(x.astype(np.float32))]


def test_neighbours_of_any_norm_with_copies(spark):
    rows = clustered(3000)
    rows += [(k, rows[17][1], 1) for k in range(3000, 4200)]  # one vector in a quarter of the rows
    rows += [(4200, None, 1), (4220, [0.0] * 16, 1), (4240, [math.nan] * 16, 1), (4260, [None] + [1.0] * 15, 1), (4280, [1.0], 1)]
    want, got = brute_neighbours(rows[:4200]), found(spark, rows + rows[:50])
    assert got.keys() == want.keys() and share(got, want) >= 0.9
    assert got[3000] == want[3000] and got[4180] == want[4180]


def shuffled(spark):
    """Rows that all stages have written for shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    none = jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_what_queries_send_does_not_grow_with_the_lists(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(rng.normal(size=(4000, 64)).astype(np.float32))]
    sent = []
    for n in (100, 10):
        monkeypatch.setattr(P, "LIST_ROWS", n)
        before = shuffled(spark)
        found(spark, rows)
        sent.append(shuffled(spark) - before)
    assert sent[1] < 1.5 * sent[0]  # with ten times as many lists, of which a query reads many


def test_blocks_of_any_size_give_the_same_neighbours(spark, monkeypatch):
    rows = clustered(2500)
    want = found(spark, rows)
    for name, n in (("ROWS", 40), ("QUERIES", 7), ("PARTS", 2), ("PART_ROWS", 1500)):
        monkeypatch.setattr(P, name, n)
    assert found(spark, rows) == want


def test_few_candidates_are_all_found(spark):
    rows = clustered(9)
    rows = [(k * 20, v, x) for k, v, x in rows]
    assert {q: [i for i, _ in w] for q, w in found(spark, rows).items()} == {q: [i for i, _ in w] for q, w in brute_neighbours(rows).items()}
    assert found(spark, []) == {} and found(spark, [(20, [1.0, 2.0], 1)]) == {}
    same = [(20 * k, [1.0, 1.0], 1) for k in range(60)]
    assert found(spark, same) == brute_neighbours(same)


def test_graph_search_meets_what_the_ratio_asks_for():
    x = np.array([v for _, v, _ in clustered(6000)])
    norm2 = float((x * x).sum(axis=1).max())
    index = P.fit(x, norm2, 6000, 20)
    assert len(index.centroids) == 47 and 1 <= index.ratio < math.inf
    q = index.lift(x[:200], query=True)
    exact = np.sqrt(((q[:, None, :] - index.centroids) ** 2).sum(axis=2))
    want = exact <= exact.min(axis=1, keepdims=True) * index.ratio
    met = np.isfinite(index.distances(q, index.ratio))
    assert (met & want).sum() >= 0.98 * want.sum()
    sizes = np.bincount(index.lists_of(x)[1], minlength=47)
    assert sizes.min() > 0 and {*index.lists_of(x)[0].tolist()} == set(range(6000))


def test_parts_are_balanced():
    x = np.array([v for _, v, _ in clustered(1000)])
    parts = P.balanced(x, 7, np.random.default_rng(0))
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000)) and {len(p) for p in parts} <= set(range(140, 146))


def test_recall(spark):
    exact = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "query_id long, vec_id long")
    assert P.recall(exact.limit(2), exact) == 2 / 3 and P.recall(exact, exact.limit(0)) == 1.0
