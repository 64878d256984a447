"""Document operators against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from smeltry.llm import components, decontaminate, jaccard_join, kd_shards, quality_rules, substring_dedup, text_stats, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "a b\nc", "x" * 3000]


def documents(spark, texts, first=0):
    rows = [(first + k, t, "s", "l", "clash", 5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard string, n_words int").repartition(4)


def passages(seed, n=200):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    parts = [[rnd.choice(words) for _ in range(rnd.randint(5, 40))] for _ in range(30)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += rnd.choice(parts) if rnd.random() < 0.5 else [rnd.choice(words) for _ in range(rnd.randint(0, 20))]
        out.append(" ".join(w))
    return out + [out[7 * k] for k in range(20)] + ODD + [" ".join(["a"] * 100), " ".join(["a"] * 40)] + [out[0]] * 30


# --- shards ---------------------------------------------------------------------


def test_shards_are_even_gapless_and_whole(spark):
    rnd = random.Random(1)
    texts = ["y" * rnd.randint(0, 300) for _ in range(700)] + ["same text"] * 350 + ODD
    rows = kd_shards.kd_shards(documents(spark, texts)).collect()
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    assert set(size) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(size.values())
    assert max(size.values()) - min(size.values()) < 0.05 * total / 8 + 3001


def test_shards_of_few_or_no_rows(spark):
    assert kd_shards.kd_shards(documents(spark, [])).collect() == []
    assert len(kd_shards.kd_shards(documents(spark, ["a", None])).collect()) == 2
    same = spark.createDataFrame([(1, "a", "s", "l")] * 5 + [(None, None, None, None)], "doc_id long, text string, source string, lang string")
    assert len(kd_shards.kd_shards(same).collect()) == 6


def test_write_shards(spark, folder):
    docs = documents(spark, [f"t{k}" for k in range(50)]).drop("shard")
    kd_shards.write_shards(docs, kd_shards.kd_shards(docs), folder + "/s")
    assert spark.read.parquet(folder + "/s").count() == 50


# --- quality --------------------------------------------------------------------


def brute_stats(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    return [len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)]


def test_statistics_equal_brute_force(spark):
    texts = passages(3) + ["a#b |c\n|\n|\nx\x1cy\x85z é", "\x0b\x0c", "a b c d e a b c d e", "l\nl\n\nl"]
    rows = text_stats.text_stats(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute_stats(texts[r.doc_id])


def test_rules_find_planted_junk(spark):
    rnd = random.Random(2)
    clean = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(20, 200))) for _ in range(400)]
    junk = [" ".join(f"w{rnd.randrange(5000)}###" for _ in range(rnd.randint(20, 200))) for _ in range(100)]
    docs = documents(spark, clean + junk)
    labels = spark.createDataFrame([(k, int(k < 400)) for k in range(0, 500, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = quality_rules.judged(docs.drop("n_words"), labels).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(400))
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(400))


def test_rules_without_labels_keep_what_the_base_keeps(spark):
    docs = documents(spark, ODD + ["a b c d e f g h i j", "q w e r t q w e r t q w"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judged(docs, none).collect()}
    assert [k for k, v in rows.items() if v[1]] == [6] and all(v[0] for k, v in rows.items() if k != 6)
    assert quality_rules.judged(docs.limit(0), none).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = quality_rules.judged(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean, junk = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean) and sum(not r.kept for r in junk) >= 0.95 * len(junk)


# --- decontamination ------------------------------------------------------------


def brute_hits(docs, items, size=10):
    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(low))
        m = min(size, len(w))
        for a in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + m]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = word.findall((t or "").translate(low)), set(), set()
        for m in {len(k) for k in windows}:
            for a in range(len(w) - m + 1):
                if x := windows.get(tuple(w[a : a + m])):
                    hit |= set(range(a, a + m))
                    found |= x
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("bound", [200_000, 0])
def test_hits_equal_brute_force(spark, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", bound)
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choice("a b C é x9".split()) for _ in range(rnd.randint(0, 60)))) for i in range(60)] + [(98, None), (99, "")]
    items = [(i, " ".join(rnd.choice("a b c é x9".split()) for _ in range(rnd.randint(0, 14)))) for i in range(12)] + [(77, None)]
    for _ in range(25):
        i, t = rnd.choice(docs[:60])
        docs[i] = (i, t + " -- " + rnd.choice(items[:12])[1] + " . " + t[:20])
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    rows = decontaminate.matches(d, spark.createDataFrame(items, "item_id long, text string")).withColumn("n_hit", decontaminate.covered_words(F.col("spans"))).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == brute_hits(docs, items)


def test_no_items_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b")] * 3 + [(1, "c"), (None, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert len(decontaminate.matches(docs, none).collect()) == 5 and decontaminate.matches(docs.limit(0), none).collect() == []
    one = spark.createDataFrame([(5, "a b")], "item_id long, text string")
    assert sorted(r["items"] == ["5"] for r in decontaminate.matches(docs, one).collect()) == [False, True, True, True, True]
    assert [r.text for r in decontaminate.clean_documents(docs.where("doc_id is null or text = 'c'"), one).collect()] == ["c"]


# --- substring dedup ------------------------------------------------------------


def brute_removed(docs, size=13):
    first, words = {}, {i: WORD.findall(t or "") for i, t in docs}
    for i in sorted(words):
        for a in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][a : a + size]), i)
    out = {}
    for i, w in words.items():
        gone = {a + k for a in range(len(w) - size + 1) if first[tuple(w[a : a + size])] < i for k in range(size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("many", "at_once"), [(50_000, 100_000), (3, 100_000), (50_000, 10)])
def test_removed_words_equal_brute_force(spark, many, at_once, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    monkeypatch.setattr(substring_dedup, "AT_ONCE", at_once)
    texts = passages(5)
    rows = substring_dedup.deduplicated(documents(spark, texts)).collect()
    want = brute_removed(list(enumerate(texts)))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want and len(rows) == len(want)
    assert all(sum(s["to"] - s["from"] for s in r.spans) == r.n_removed for r in rows)
    assert sum(v[1] > 0 for v in want.values()) > 50


def test_rows_without_a_key_stay(spark):
    t = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(None, t), (None, t), (4, t), (4, t), (5, t)], "doc_id long, text string")
    rows = [(r.doc_id, r.n_removed) for r in substring_dedup.deduplicated(docs).collect()]
    assert sorted(rows, key=str) == [(4, 0), (4, 0), (5, 20), (None, 0), (None, 0)]
    assert substring_dedup.deduplicated(docs.limit(0)).collect() == []
    kept = substring_dedup.kept_documents(documents(spark, [t, t + " x y", None, "z"]).withColumn("n_chars", F.lit(1).cast("long")))
    assert {r.doc_id: r.text for r in kept.collect()} == {0: t, 1: "x y", 2: None, 3: "z"}


# --- similarity join ------------------------------------------------------------


def brute_classes(docs):
    sets, inverted = {}, collections.defaultdict(list)
    for i, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for k, shared in collections.Counter(k for g in s for k in inverted[g]).items():
            if 100 * shared >= 80 * (len(s) + len(sets[k]) - shared):
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
        for g in s:
            inverted[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1024, 2])
def test_classes_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BROADCAST_SETS", 500_000 if block > 2 else 0)
    rnd, docs = random.Random(block), []
    for _ in range(25):
        base = [rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(rnd.choice([3, 5, 8, 10, 14, 20, 30, 60, 150, 400]))]
        for c in range(8):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                k, p = rnd.random(), rnd.randrange(len(w)) if w else 0
                if k < 0.4:
                    w[p : p + 1] = [f"zz{rnd.randint(0, 99)}"]
                elif k < 0.6:
                    del w[p : p + 2]
                else:
                    w[p:p] = ["ins"] * rnd.randint(1, 4)
            docs.append((len(docs), " ".join(w).upper() if c == 3 else " ".join(w)))
    docs += [(9000 + k, t) for k, t in enumerate(ODD)] + [(9100, "A B C")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_shingles int").repartition(4)
    rows = jaccard_join.classes(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_classes(docs) and len(rows) == len(docs)


def test_classes_of_nothing_and_of_rows_without_a_key(spark):
    docs = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (8, None), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard_join.classes(docs).collect()), key=str) == [(7, 7), (8, 8), (None, 7), (None, None)]
    assert jaccard_join.classes(docs.limit(0)).collect() == []
    assert len(jaccard_join.one_of_each(docs).collect()) == 4


def test_pigeonhole_of_every_band():
    for j in range(40):
        for sets in (10, 10**6, 10**11):
            x, y = jaccard_join.allocation(j, sets)
            assert x + 2 * y > jaccard_join.band_limit(j) or jaccard_join.band_limit(j) == 0
    for n in range(1, 400):
        for m in range(n, n * 100 // 80 + 1):
            assert jaccard_join.band_of(n) in jaccard_join.schemes(m) or jaccard_join.band_limit(jaccard_join.band_of(n)) == 0
            assert jaccard_join.most_difference(n + m) <= jaccard_join.band_limit(jaccard_join.band_of(n)) or n * 100 < 80 * m


def test_sketches_never_exceed_the_difference():
    rnd = random.Random(6)
    for _ in range(200):
        a = [str(rnd.randrange(50)) for _ in range(rnd.randint(5, 300))]
        b = a[: rnd.randint(5, len(a))] + [str(rnd.randrange(50)) for _ in range(rnd.randint(0, 60))]
        s, t = (jaccard_join.shingles(" ".join(w)) for w in (a, b))
        assert jaccard_join.least_difference(jaccard_join.sketch(s), jaccard_join.sketch(t)) <= len(set(s.tolist()) ^ set(t.tolist()))


def test_word_hashes_by_segments(monkeypatch):
    text = " ab\nabc  é\x0bab " + "z" * 50 + " ab"
    whole = word_hashes.word_hashes(text.encode())
    assert len(whole) == len(text.encode().split()) and whole[0] == whole[3] == whole[5] != whole[1]
    for size in (1, 3, 7):
        monkeypatch.setattr(word_hashes, "SEGMENT", size)
        assert word_hashes.word_hashes(text.encode()).tolist() == whole.tolist()
    assert len(word_hashes.word_hashes(b"")) == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.label for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_strings_with_a_common_beginning_are_a_dimension(spark):
    rows = [(k, "x" * 50, "en", f"https://{'ab'[k % 2]}.org/") for k in range(200)] + [(200, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    ranks = kd_shards.ranked(docs, "source").groupBy("source").count().collect()
    assert {(r.source, r["count"]) for r in ranks} == {(0, 1), (1, 100), (2, 100)}
    shards = {}
    for r in kd_shards.kd_shards(docs.where("doc_id < 200"), shards=2).collect():
        shards.setdefault(r.shard, set()).add(r.doc_id % 2)
    assert sorted(map(len, shards.values())) == [1, 1]


def thue_morse(n, first="a", second="b"):
    return "".join(first if bin(k).count("1") % 2 == 0 else second for k in range(n))


def test_words_of_one_pattern_differ(spark):
    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    h = word_hashes.word_hashes(f"{one} {two} {one}".encode())
    assert h[0] == h[2] != h[1]
    rest = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, one), (4, two)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.deduplicated(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in jaccard_join.classes(docs.where("doc_id > 2")).collect()} == {3: 3, 4: 4}


def test_rows_go_by_their_own_text_not_by_their_key(spark):
    words = lambda a: " ".join(f"w{k}" for k in range(a, a + 30))
    docs = spark.createDataFrame([(1, words(0)), (5, words(0)), (5, words(100)), (None, words(0)), (6, None)], "doc_id long, text string").withColumn("text_hash", F.lit("clash"))
    left = jaccard_join.one_of_each(docs)
    assert sorted(map(str, left.collect())) == sorted(map(str, [r for r in docs.collect() if (r.doc_id, r.text) != (5, words(0))]))
    items = spark.createDataFrame([("i", words(0))], "item_id string, text string")
    kept = decontaminate.clean_documents(docs, items)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "6"] and kept.columns == docs.columns
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0 and decontaminate.clean_documents(docs.limit(0), items).count() == 0


def test_a_group_of_near_copies_is_one_component_of_few_proposals(spark, monkeypatch):
    """Each copy differs from the text in some words of its own, so most pairs don't link but all are reachable."""
    rnd = random.Random(6)
    text = [f"w{k}" for k in range(200)]
    docs = []
    for k in range(900):
        t = list(text)
        for i in rnd.sample(range(0, 200, 5), rnd.choice((1, 2, 3))):
            t[i] = f"x{k}_{i}"
        docs.append((k, " ".join(t)))
    sizes = []
    propose = jaccard_join._proposals

    def counted(*args):
        out = propose(*args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_proposals", counted)
    monkeypatch.setattr(jaccard_join, "STARS", 0)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    rows = jaccard_join.classes(df).collect()
    assert {r.component_id for r in rows} == {0}
    assert sum(sizes) < 20 * len(docs)


def test_proposals_are_the_nearest_of_a_component():
    pairs = [(1, 2, 1, 2, 5), (1, 3, 1, 3, 4), (2, 3, 2, 3, 9), (4, 5, 4, 1, 7)]
    assert jaccard_join.nearest(pairs, 1) == [(1, 2, True), (1, 3, True), (4, 5, True)]
    assert jaccard_join.nearest(pairs, 9) == [(a, b, False) for a, b, *_ in pairs] and jaccard_join.nearest([], 1) == []


def test_short_sketches_never_exceed_the_difference_and_part_unrelated_sets():
    rnd = random.Random(8)
    for n in (5, 60, 400, 3000):
        a = [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
        near = [w if rnd.random() < 0.97 else "x" for w in a]
        other = [f"v{rnd.randint(0, 10**6)}" for _ in range(n)]
        s, t, u = (jaccard_join.shingles(" ".join(w)) for w in (a, near, other))
        short = lambda x: jaccard_join.coarse(jaccard_join.sketch(x), len(x))
        assert jaccard_join.least_difference(short(s), short(t)) <= len(set(s.tolist()) ^ set(t.tolist()))
        assert jaccard_join.least_difference(short(s), jaccard_join.sketch(t)) <= len(set(s.tolist()) ^ set(t.tolist()))
        assert n < 60 or jaccard_join.least_difference(short(s), short(u)) > jaccard_join.most_difference(len(s) + len(u))
        assert len(short(s)) * 8 <= max(64, 1.2 * n + 64)


def test_only_signatures_with_pairs_held_back_are_compared_again(spark, monkeypatch):
    """Unrelated texts under one signature meet once, in short sketches; a chain of copies goes on."""
    seen = []
    propose = jaccard_join._proposals

    def noted(groups, *args):
        seen.append((groups.select("sig").distinct().count(), *args[2:]))
        return propose(groups, *args)

    monkeypatch.setattr(jaccard_join, "_proposals", noted)
    monkeypatch.setattr(jaccard_join, "STARS", 0)
    rnd = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(40))
    docs = [(k, f"{passage} " + " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(300))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in jaccard_join.classes(df).collect()} == {k: k for k in range(40)}
    assert seen[0][0] > 0 and seen[0][1:] == (1, "coarse") and len(seen) == 1


def test_a_very_long_text_takes_time_in_proportion(spark):
    import time

    items = spark.createDataFrame([("i", " ".join(f"w{k}" for k in range(300_000, 300_030)))], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(640_000)))], "doc_id long, text string")
    start = time.time()
    got = decontaminate.matches(docs, items).withColumn("n_hit", decontaminate.covered_words(F.col("spans"))).first()
    assert time.time() - start < 60 and (got.n_words, got.n_hit) == (640_000, 30)
    assert (min(s["from"] for s in got.spans), max(s["to"] for s in got.spans)) == (300_001, 300_030)


def test_shards_of_documents_with_a_column_of_that_name(spark, folder):
    docs = spark.createDataFrame([(k, f"text {k}", "own", -k) for k in range(40)], "doc_id long, text string, shard string, slot int").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(6)})
    placed = kd_shards.kd_shards(docs)
    kd_shards.write_shards(docs, placed, f"{folder}/clash")
    back = spark.read.parquet(f"{folder}/clash")
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == [(k, "own", -k) for k in range(40)]
    assert {(r.doc_id, r.shard_) for r in back.collect()} == {(r.doc_id, r.shard) for r in placed.collect()}
