"""Alignment of tokens against the libraries and a plain reading of the rules."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from smeltry.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGE = [None, "", " ", "\n", "\n\n\n a", "a  b", "▁x", "é漢\x00z", "<s> </s> <unk>", "<|endoftext|> a", "a\r\n\tb\xa0c", "one\ntwo\nthree", "'s 't\n'll", "word " * 3000, "x" * 5000]


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of every text, by whole texts and sets."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = T._byte_letters()

    def raw(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for t in texts:
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        x, y = [bytes(letters[c] for c in one.id_to_token(i)) for i in a], [raw(i) for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(w) for w in x]).tolist(), np.cumsum([len(w) for w in y]).tolist()
        at_a, at_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
        groups, links, p, q = [], [], 0, 0
        for e in sorted(at_a.keys() & at_b.keys()):
            i, j = at_a[e], at_b[e]
            groups.append(",".join(map(str, a[p : i + 1])) + "|" + ",".join(map(str, b[q : j + 1])))
            links.append((a[i], b[j]))
            p, q = i + 1, j + 1
        counts.update(links)
        docs.append((len(a), len(b), groups, links))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [
        zero if d is None else (
            d[0], d[1], len(d[2]), len(d[3]), sum(counts[k] == top[k[1]] for k in d[3]), sum(counts[k] for k in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest(),
        )
        for d in docs
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def results(df):
    return sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in df.collect())


@pytest.fixture(scope="module")
def texts(sf):
    import pyarrow.parquet as pq

    rnd = random.Random(5)
    parts = [*"aabehtno  \n\t.,▁é漢<>s/0'", "  ", "the", "ing", "\n\n", "'ll", " word", "\nline"]
    odd = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    given = pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    return [*EDGE, *odd, *given]


def test_equals_the_libraries_and_plain_sets(spark, texts):
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `pairs` string, row int").repartition(5)
    want = sorted((str(k), *x) for k, x in enumerate(brute(texts)))
    assert results(T.alignment(df, A, B)) == want
    assert sum(w[3] for w in want) > 10_000


def test_rare_pairs_by_shuffle_give_the_same(spark, texts, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = results(T.alignment(df, A, B))
    monkeypatch.setattr(T, "BROADCAST_PAIRS", 200)
    got = T.alignment(df, A, B)
    assert results(got) == want


def test_repeated_rows_null_keys_and_nothing(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (2, None)], "doc_id long, text string")
    got = results(T.alignment(df, A, B))
    assert [r[0] for r in got] == ["1", "1", "2", "None"]
    assert got[0] == got[1] and got[0][1:] == got[3][1:] and got[0][6] == 3 * got[0][4] and got[2][1:] == (0, 0, 0, 0, 0, 0, "")
    assert T.alignment(df.limit(0), A, B).count() == 0
    named = df.withColumnsRenamed({"doc_id": "key", "text": "ids"}).withColumn("n_a", F.lit("x"))
    assert T.alignment(named, A, B, "key", "ids").columns == ["key", *COLUMNS]


def test_common_ends_of_random_cuts():
    rnd = random.Random(3)
    for n in (1, 2, 5, 40, 700):
        for _ in range(60):
            a, b = (np.array(sorted({*rnd.sample(range(1, 2 * n + 1), rnd.randint(1, n)), 2 * n + 1}), np.int64) for _ in range(2))
            x, y = T.common_ends(a, b)
            assert a[x].tolist() == b[y].tolist() == sorted({*a.tolist()} & {*b.tolist()})
    long = np.arange(1, 100_001, dtype=np.int64)
    assert T.common_ends(long, np.delete(long, [10, 50_000]))[0].tolist() == [k for k in range(100_000) if k not in (10, 50_000)]
    assert [len(x) for x in T.common_ends(long[:3], long[5:])] == [0, 0]


def test_a_full_table_changes_nothing(texts, monkeypatch):
    some = [t for t in texts if t]
    want = T.Pair(A, B).ids(some)
    monkeypatch.setattr(T, "REMEMBER", 50)
    own = T.Pair(A, B)
    assert [own.ids([t])[0] for t in some] == want
