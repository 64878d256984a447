"""Similarity join of documents on the Jaccard similarity of their 5-word shingles.

Candidates come from partitioning the universe of shingles. Sets whose sizes share a
band differ by at most H shingles if they link. The universe is hashed into segments:
`x` of them are indexed as they are, `y` with their one-deletion neighbourhood. A
segment of the first kind that differs uses up one difference, of the second kind
two, so with x + 2y > H some segment matches: equal, or one element apart. x and y
are chosen for each band by cost: signatures written against false candidates expected
from the band's size. Empty segments say nothing; a slack of E makes up for a set's
empty ones, and only sets with more of them index those too. No link is lost.

Equal sets are one. Within the sets of a signature only links to its first set are
tried, then components are formed; twice the sets of other components are tried with
one set of one component. Then components are joined in rounds: under each signature a
component proposes its nearest sets of other components, by parity sketches, whose
differing bits never exceed the differing shingles. Proposals are verified, components
that link become one, and the next round proposes four times as many, or all once
nothing links, until no pair of different components that sketches allow is untested.
Only signatures under which some pair was held back are compared again. The first round
and the pairs to be tried meet sketches of about a bit a shingle, which tell unrelated sets apart;
what is left meets the whole ones. So a group of near copies takes proposals in proportion to its components, not all its pairs, and no link between
components is lost. All links are verified exactly by the shingles, as 64-bit hashes.

Words are split at ASCII white space with A-Z lower-cased; fewer than five words make
one shingle; null texts and texts without words have no shingle and no link. Each row
of the input gives one row; rows of equal text are in one component.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smeltry.llm.common import small_batches, table, written
from smeltry.llm.components import components
from smeltry.llm.sentence_pieces import _slices
from smeltry.llm.word_hashes import mixed, word_hashes

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Growth of sizes from band to band.
RATIO = 1.25
#: Share of shingles taken as common to unrelated texts, for the cost of an allocation.
COMMON = 0.05
#: With fewer, shingles that cancel out on a bit let many pairs just below the bound pass.
SKETCH_BITS = 8
#: Bits a shingle of the short sketch, and bits more: unrelated sets differ on half of them, linked ones on no more than 0.25 a shingle.
COARSE_BITS, COARSE_MORE = 0.6, 32
#: Sets that are looked up by broadcast, at 16 bytes each; more are joined by shuffle.
BROADCAST_SETS = 500_000
#: Rounds in which components are joined by single sets before they propose pairs.
STARS = 2
#: Members of a signature compared in one block.
BLOCK = 1024
#: Sets that a task remembers to have indexed already.
SEEN = 1_000_000
_POWERS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = word_hashes((text or "").encode().lower())
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return mixed((h * _POWERS[:n]).sum(dtype=np.uint64, keepdims=True), n)
    rows = n - WORDS + 1
    total = h[:rows] * _POWERS[0]
    for k in range(1, WORDS):
        total += h[k : k + rows] * _POWERS[k]
    return np.unique(total)


def set_id(s: np.ndarray) -> int:
    return int(mixed(s, 7).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit; at least SKETCH_BITS bits a shingle."""
    bits = 1 << max(6, (SKETCH_BITS * len(s) - 1).bit_length())
    odd = np.bincount((mixed(s, 11) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def coarse(s: bytes, n: int) -> bytes:
    """The sketch of n shingles, folded to few bits."""
    bits = 1 << max(6, math.ceil(math.log2(COARSE_BITS * n + COARSE_MORE)))
    if len(s) * 8 <= bits:
        return s
    return np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, bits // 64), axis=0).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference; the longer sketch is folded."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    p, q = len(a) * 8, len(b) * 8
    if p < q:
        x, y, p, q = y, x, q, p
    while p > q:
        p //= 2
        x = (x >> p) ^ (x & (1 << p) - 1)
    return (x ^ y).bit_count()


def most_difference(total: int) -> int:
    """Largest symmetric difference of linked sets whose sizes add up to `total`."""
    return total - 2 * -(-PERCENT * total // (100 + PERCENT))


@lru_cache(maxsize=1)
def bands() -> list[tuple[int, int]]:
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo, math.floor(lo * RATIO))
        out.append((lo, hi))
        lo = hi + 1
    return out


def band_of(n: int) -> int:
    edges = bands()
    lo, hi = 0, len(edges) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if edges[mid][1] < n else (lo, mid)
    return lo


def band_limit(j: int) -> int:
    """H: the largest difference of linked sets of which the smaller is in band j."""
    hi = bands()[j][1]
    top = hi + hi * 100 // PERCENT
    return max(most_difference(t) for t in range(max(2, top - 20), top + 1))


def allocation(j: int, sets: int) -> tuple[int, int]:
    """(x, y): exact and one-deletion segments of band j that cost least for so many sets."""
    lo, hi = bands()[j]
    n, limit = (lo + hi) / 2, band_limit(j)
    best: tuple[float, int, int] = (math.inf, 0, 0)
    for slack in (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48):
        for share in (0.0, 0.25, 0.5, 1.0):
            need = limit + 1 + slack
            y = math.floor(share * need / 2)
            x = need - 2 * y
            mu = n / (x + y)
            empty, single = math.exp(-mu), math.exp(-mu) * (1 + mu)
            loss = x * empty + 2 * y * single
            over = 0.5 * math.erfc((slack + 0.5 - loss) / math.sqrt(2 * max(loss, 0.05)))  # sets that index empty segments
            bare = math.exp(-mu * (1 - COMMON)) * (1 - math.exp(-mu * COMMON))  # segments of common shingles alone
            nearly = bare * (1 + mu)
            pairs = sets * (x * bare**2 + y * nearly**2 + over**2 * (x * empty**2 + y * single**2))
            cost = x + y + y * mu + pairs
            if cost < best[0]:
                best = cost, x, y
    return best[1], best[2]


def schemes(n: int) -> list[int]:
    """Bands under which a set of n shingles is indexed: its own, and those of smaller partners."""
    if n < 1:
        return []
    return [j for j in range(band_of(-(-n * PERCENT // 100)), band_of(n) + 1) if band_limit(j) > 0]


def signatures(place: np.ndarray, content: np.ndarray, j: int, x: int, y: int) -> np.ndarray:
    """Signatures of a set under band j, from two mixes of its shingles."""
    segment = place % np.uint32(x + y)
    # sixteen bits are sorted by radix
    order = np.argsort(segment.astype(np.uint16) if x + y < 1 << 16 else segment, kind="stable")
    segment, content = segment[order].astype(np.int64), content[order]
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    which, size = segment[first], np.diff(np.append(first, len(segment)))
    total = np.add.reduceat(content, first)
    out = [(which, total)]
    each = np.repeat(np.arange(len(which)), size)
    near = (segment >= x) & (size[each] > 1)
    if near.any():
        out.append((segment[near], total[each[near]] - content[near]))
    full = np.zeros(x + y, np.int64)
    full[which] = size
    bare = np.flatnonzero(np.where(np.arange(x + y) < x, full == 0, full <= 1))
    if (bare < x).sum() + 2 * (bare >= x).sum() > x + 2 * y - band_limit(j) - 1:
        out.append((bare, np.zeros(len(bare), np.uint64)))
    segments, sums = (np.concatenate(c) for c in zip(*out, strict=True))
    return mixed(sums + mixed(segments.astype(np.uint64), 2 * j + 101), 13).view(np.int64)


def _batches(df: DataFrame, key: str, text: str, row, schema: str, names: list[str]):
    """Rows (key, text_hash, *columns) of `row(shingles)` for every text; text_hash is xxhash64."""
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        for part in _slices(batches):
            rows = [row(shingles(x)) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("text_hash"), *[pa.array(c) for c in zip(*rows, strict=True)]], ["key", "text_hash", *names])

    return source.mapInArrow(run, f"key {kind}, text_hash long, {schema}").withColumnRenamed("key", key)


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, set_id, sketch and coarse sketch of every row."""
    row = lambda s: (len(s), set_id(s), whole := sketch(s), coarse(whole, len(s)))
    return _batches(docs, key, text, row, "n_shingles long, set_id long, sketch binary, coarse binary", ["n_shingles", "set_id", "sketch", "coarse"])


def indexed(docs: DataFrame, plan: dict[int, tuple[int, int]], text: str = "text") -> DataFrame:
    """(sig, set_id) of every set, once for each task that meets it."""
    source = docs.select(F.col(text).cast("string").alias("text"))

    def run(batches):
        seen, texts = set(), set()
        for part in _slices(batches):
            sigs, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x in part.column("text").to_pylist():
                if not x or (t := hash(x)) in texts:  # inside one process only
                    continue
                s = shingles(x)
                if len(texts) >= SEEN:
                    texts.clear()
                    seen.clear()
                texts.add(t)
                if not len(s) or (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                place, content = (mixed(s, 3) >> np.uint64(33)).astype(np.uint32), mixed(s, 5)
                for j in schemes(len(s)):
                    sigs.append(signatures(place, content, j, *plan[j]))
                    ids.append(np.full(len(sigs[-1]), i))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], ["sig", "set_id"])

    return source.mapInArrow(run, "sig long, set_id long")


def _sizes_allow(n: Column, m: Column) -> Column:
    return (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT)


def _could_link(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that sizes and sketches don't rule out: short ones first, whole ones for what these leave."""
    left = written(_near(pairs, facts, "coarse"))
    ids = written(left.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    few = ids.count() <= BROADCAST_SETS
    return _near(left, facts.join(F.broadcast(ids) if few else ids, "set_id", "left_semi"), "sketch")


def _near(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) of sets that sizes and one of the sketches don't rule out."""
    of = lambda s: facts.select(F.col("set_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col(column).alias(f"sketch_{s}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    both = both.where(_sizes_allow(F.col("n_a"), F.col("n_b")))

    def run(batches):
        for part in batches:
            c = {n: part.column(n).to_pylist() for n in ("n_a", "n_b", "sketch_a", "sketch_b")}
            near = [least_difference(p, q) <= most_difference(n + m) for n, m, p, q in zip(c["n_a"], c["n_b"], c["sketch_a"], c["sketch_b"], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, facts: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) that link, by their shingles. Only the sets in pairs are read. pairs is read often: written."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(facts.select("set_id", F.col("doc_id").alias("rep")), "set_id"))
    few = ids.count() <= BROADCAST_SETS
    rows = docs.select(F.col(key).alias("own_rep"), F.col(text).alias("text"))
    texts = rows.join(F.broadcast(ids) if few else ids, F.col("own_rep").eqNullSafe(F.col("rep")))
    sets = _batches(texts, "set_id", "text", lambda s: (s.view(np.int64).tolist(), set_id(s)), "shingles array<bigint>, own long", ["shingles", "own"])
    sets = written(sets.where("own = set_id").drop("own", "text_hash"))
    of = lambda s: sets.select(F.col("set_id").alias(s), F.col("shingles").alias(f"s_{s}"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - shared
    return pairs.join(of("a"), "a").join(of("b"), "b").where(shared * 100 >= union * PERCENT).select("a", "b")


def _grouped(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(sig, set_id, n_shingles) of signatures of three sets or more; of those with the same sets one stays."""
    rows = members.select("sig", "set_id").union(members.select("sig", F.col("center"))).distinct()
    groups = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("h"), F.min("set_id").alias("lo"), F.max("set_id").alias("hi"))
    one = groups.where("n > 2").groupBy("n", "h", "lo", "hi").agg(F.min("sig").alias("sig")).select("sig")
    return rows.join(one, "sig").join(facts.select("set_id", "n_shingles"), "set_id")


def _labelled(groups: DataFrame, labels: DataFrame, turn: int = 0) -> DataFrame:
    """(sig, set_id, n_shingles, label) of the signatures whose sets are in more than one component, and one of these sets.

    Each turn takes a set of another component.
    """
    rows = groups.join(labels, F.col("set_id") == F.col("id"), "left").select("sig", "set_id", "n_shingles", F.coalesce("label", "set_id").alias("label"))
    order = F.xxhash64("label", F.lit(turn))
    open_ = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.max(F.struct(order.alias("order"), "label", "set_id", "n_shingles")).alias("top")).where("l0 <> l1")
    return rows.join(open_.select("sig", "n", "top"), "sig")


def _proposals(groups: DataFrame, labels: DataFrame, facts: DataFrame, most: int, column: str = "sketch") -> DataFrame:
    """(a, b, sig): pairs of sets under one signature that lie in different components and may link.

    A group of any size is compared block by block, each pair of blocks a task of its
    own. Of the pairs that pass the sketches only those leave it that are among the
    `most` nearest of one of their components there. Signatures where some stayed are
    rows of their own, with neither a nor b.
    """
    placed = _labelled(groups, labels).select("sig", "set_id", "label", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n_shingles").join(facts.select("set_id", F.col(column).alias("sketch")), "set_id")
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = placed.withColumn("own", own).withColumn("other", other).select(
        "sig", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "set_id", "label", "n_shingles", "sketch"
    )

    def run(batches):
        held: list[tuple] = []
        group = None
        for batch in batches:
            out: list[tuple] = []
            for r in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if r[:3] != group:
                    out += of_cell(held, group)
                    held, group = [], r[:3]
                held.append(r[3:])
            yield _rows(out)
        yield _rows(of_cell(held, group))

    def of_cell(rows, cell):
        pairs = nearest(compared(rows, cell), most)
        held_back = [(None, None, cell[0])] if pairs and pairs[0][2] else []
        return [(a, b, None) for a, b, _ in pairs] + held_back

    def _rows(out):
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "sig"])

    return cells.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q").mapInArrow(run, "a long, b long, sig long").distinct()


def nearest(pairs: list[tuple[int, int, int, int, int]], most: int) -> list[tuple[int, int, bool]]:
    """(a, b, more) of the pairs (a, b, label_a, label_b, difference) that are among the `most` nearest of a component."""
    if not pairs:
        return []
    a, b, label_a, label_b, apart = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
    keep = np.zeros(len(a), bool)
    label, twice = np.concatenate((label_a, label_b)), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((b[twice], a[twice], apart[twice], label))
    label = label[order]
    rank = np.arange(len(order)) - np.searchsorted(label, label)
    keep[twice[order[rank < most]]] = True
    more = not keep.all()
    return [(x, y, more) for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True)]


#: More pairs than a block can have.
EVERY = BLOCK * BLOCK
#: Members of a block from which on all of them are compared by arrays.
MANY = 48


def compared(rows: list[tuple], cell: tuple | None) -> list[tuple[int, int, int, int, int]]:
    """(a, b, label_a, label_b, least difference) of a cell's rows (block, set_id, label, n, sketch) that may link, of different components.

    A cell of two blocks has the pairs between them, a cell of one block those within.
    """
    if len(rows) < 2 or cell is None:
        return []
    rows.sort(key=lambda r: (r[3], r[1]))
    within = cell[1] == cell[2]
    if len(rows) < MANY:
        out = []
        known = [(*r[:4], len(r[4]), int.from_bytes(r[4], "little")) for r in rows]
        for i, (own, a, label, n, size, s) in enumerate(known):
            for j in range(i + 1, len(known)):
                other, b, label_b, m, size_b, t = known[j]
                if m * PERCENT > n * 100:
                    break
                if label == label_b or not within and own == other:
                    continue
                apart = (s ^ t).bit_count() if size == size_b else least_difference(rows[i][4], rows[j][4])
                if apart <= most_difference(n + m):
                    out.append((a, b, label, label_b, apart) if a < b else (b, a, label_b, label, apart))
        return out
    block, ids, label, n = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    bits = folded([r[4] for r in rows])
    short = bits
    while short.shape[1] > 1 and short.shape[1] * 64 >= 2 * n[-1]:  # a bit a shingle rules most pairs out
        short = short[:, : short.shape[1] // 2] ^ short[:, short.shape[1] // 2 :]
    last = np.searchsorted(n, n * 100 // PERCENT, side="right")
    found = []
    for i in range(len(n)):
        k = np.arange(i + 1, last[i])
        k = k[(label[k] != label[i]) & ((block[k] != block[i]) | within)]
        for some in (short, bits) if short is not bits else (bits,):
            apart = np.bitwise_count(some[k] ^ some[i]).sum(axis=1, dtype=np.int64)
            total = n[k] + n[i]
            near = apart <= total - 2 * -(-PERCENT * total // (100 + PERCENT))
            k, apart = k[near], apart[near]
        for j, d in zip(k.tolist(), apart.tolist(), strict=True):
            x, y = (i, j) if ids[i] < ids[j] else (j, i)
            found.append((int(ids[x]), int(ids[y]), int(label[x]), int(label[y]), d))
    return found


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest."""
    size = min(map(len, sketches))
    out = np.zeros((len(sketches), size // 8), np.uint64)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets, labels): every row's key, n_shingles and set_id; the component of each linked set (id, label)."""
    small_batches(docs.sparkSession)
    sets = written(shingle_sets(docs, key, text).withColumnRenamed(key, "doc_id"))
    facts = written(sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"), F.min("coarse").alias("coarse")))
    step = F.floor(F.log(F.col("n_shingles")) / math.log(RATIO)).cast("int")
    counts = {r[0]: r[1] for r in facts.groupBy(step).count().collect()}
    top = facts.agg(F.max("n_shingles")).first()[0] or 1
    plan = {j: allocation(j, counts.get(math.floor(math.log(bands()[j][1]) / math.log(RATIO)), 0)) for j in range(band_of(top) + 1)}
    first = F.first("set_id").over(Window.partitionBy("sig").orderBy("set_id"))
    members = written(indexed(docs, plan, text).withColumn("center", first).where("center <> set_id"))
    stars = members.select(F.least("center", "set_id").alias("a"), F.greatest("center", "set_id").alias("b")).distinct()
    tested = written(_could_link(stars, facts))
    links = written(verified(tested, facts, docs, key, text))
    labels = components(links)
    groups = written(_grouped(members, facts))
    for turn in range(STARS):
        # the sets of other components are tried with one set of one component
        rows = _labelled(groups, labels, turn).where("label <> top.label").where(_sizes_allow(F.col("n_shingles"), F.col("top.n_shingles")))
        stars = rows.select(F.least("set_id", "top.set_id").alias("a"), F.greatest("set_id", "top.set_id").alias("b")).distinct()
        new = written(_could_link(stars, facts).join(tested, ["a", "b"], "left_anti"))
        found = written(verified(new, facts, docs, key, text))
        if not found.limit(1).count():
            break
        tested, links = tested.union(new), links.union(found)
        labels = components(links)
    most, column = 1, "coarse"
    while True:
        proposed = written(_proposals(groups, labels, facts, most, column))
        new = written(_could_link(proposed.where("sig is null").select("a", "b").join(tested, ["a", "b"], "left_anti"), facts))
        linked = False
        if new.limit(1).count():
            found = written(verified(new, facts, docs, key, text))
            tested = tested.union(new)
            linked = bool(found.limit(1).count())
            if linked:
                links = links.union(found)
                labels = components(links)
        left = proposed.where("sig is not null").select("sig")
        if not left.limit(1).count():
            break
        groups = written(groups.join(left, "sig", "left_semi"))
        # where the nearest don't link any more, what is left is tested at once
        most, column = most * 4 if linked or column == "coarse" else EVERY, "sketch"
    return sets.drop("sketch", "coarse"), labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links) and text_hash of every row."""
    sets, labels = joined(docs, key, text)
    least = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    known = least.join(labels, F.col("set_id") == F.col("id"), "left").select("set_id", "least", F.coalesce("label", "set_id").alias("label"))
    smallest = known.groupBy("label").agg(F.min("least").alias("component_id"))
    found = known.join(smallest, "label").select("set_id", "component_id")
    out = sets.join(found, "set_id", "left")
    own: Column = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", own.alias("component_id"), "text_hash")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents but for those that a link joins to a smaller key; rows with a null key stay.

    A row goes by its own text: another text of the same key is judged by itself.
    """
    more = classes(docs, key, text).where(F.col("component_id") < F.col(key)).select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(more, (docs[key] == F.col("_key")) & (F.xxhash64(docs[text].cast("string")) == F.col("_hash")), "left_anti").select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("text_hash")
