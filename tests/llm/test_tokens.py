"""Tokenizers against their libraries, record files against a plain reading."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from smeltry.llm import piece_bpe, sentence_pieces, token_counts, token_files

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
EDGE = [None, "", " ", "  ", "\n", "\n\n a", " a", "a ", "a  b", "▁x", "a▁", "é漢\x00z", "<s> </s> <unk>", "x" * 5000, "the\n  of", "<|endoftext|> a", "a\r\n\tb\xa0c"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    alphabet = [*"aabehtno  \n\t.,▁é漢\x00<>s/0'", "  ", "     ", "the", "ing", "\n\n", "'ll", "\r\n"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def frame(spark, texts):
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, key int").repartition(3)


def test_ids_and_decoded_text_equal_the_library(pieces):
    model = piece_bpe.load(MODEL)
    known = piece_bpe.id_table(model)
    for t in [*filter(None, EDGE), *random_texts(3000, 1)]:
        ids = memoryview(b"".join(map(known.__getitem__, piece_bpe.chunks(t)))).cast("I").tolist()
        assert ids == pieces.encode(t), repr(t)
        assert model.decode([1, *ids, 2]) == pieces.decode([1, *ids, 2])


def test_decoding_any_ids_equals_the_library(pieces):
    model, rnd = piece_bpe.load(MODEL), random.Random(4)
    for _ in range(2000):
        ids = [rnd.choice((rnd.randrange(3, 32000), rnd.randrange(3, 259))) for _ in range(rnd.randint(0, 6))]
        assert model.decode(ids) == pieces.decode(ids), ids


def test_counts_at_every_prefix(pieces):
    known = piece_bpe.count_table(piece_bpe.load(MODEL))
    for t in [*EDGE[:13], "the\n  of", *random_texts(150, 2)]:
        t = t or ""
        assert token_counts.counts_at_prefixes(t, known).tolist() == [len(pieces.encode(t[:i])) for i in range(len(t) + 1)], repr(t)


def test_a_full_table_changes_nothing(pieces, monkeypatch):
    monkeypatch.setattr(piece_bpe, "REMEMBER", 3)
    known = piece_bpe.id_table(piece_bpe.load(MODEL))
    for t in random_texts(50, 3):
        assert memoryview(b"".join(map(known.__getitem__, piece_bpe.chunks(t)))).cast("I").tolist() == pieces.encode(t)
        known.keep_small()


def test_encode_decode_frames(spark, pieces):
    texts = EDGE + ["the same", "the same"]
    df = frame(spark, texts)
    encoded = sentence_pieces.encode(df, MODEL)
    back = {r.doc_id: r.decoded for r in sentence_pieces.decode(encoded, MODEL).collect()}
    got = {r.doc_id: r for r in sentence_pieces.encode(df, MODEL, decoded=True).select("doc_id", *sentence_pieces.digest_columns()).collect()}
    for k, t in enumerate(texts):
        ids = [1, *pieces.encode(t or ""), 2]
        assert back[k] == pieces.decode(ids)
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()
    assert sentence_pieces.encode(df.limit(0), MODEL).collect() == []


def test_budgets_from_stored_counts(spark, pieces):
    texts = EDGE[:13] + ["of the king " * 30]
    rows = token_counts.prefix_counts(frame(spark, texts), MODEL, limit=20)
    rows = rows.withColumn("ten", token_counts.count_of_prefix(F.col("counts"), F.lit(10))).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(pieces.encode(t)))
        assert r.fit_chars == max(i for i in range(len(t) + 1) if len(pieces.encode(t[:i])) <= 20)
        assert r.ten == (len(pieces.encode(t[:10])) if len(t) >= 10 else None)


def test_byte_level_ids_equal_the_library():
    ours, theirs = token_files.load(BYTES, "<u4"), Tokenizer.from_file(BYTES)
    for t in [*filter(None, EDGE), *random_texts(3000, 5)]:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t)


def test_byte_level_ids_of_lines_and_marks_equal_the_library():
    ours, theirs, rnd = token_files.load(BYTES, "<u4"), Tokenizer.from_file(BYTES), random.Random(9)
    word, between = ["foo", "Bar,", "a.", "x!?", "it's", "é)", "12;", "", "\t", "\x85", "\x1c"], [" ", "\n", " ", " \n", "\n\n", "\n\t", "\r\n", "\u2003", "\t\n"]
    for _ in range(5000):
        t = "".join(rnd.choice(word) + rnd.choice(between) for _ in range(rnd.randint(1, 9)))
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("wide", [False, True])
def test_records_come_back(spark, folder, wide, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    texts = EDGE + ["again", "again"]
    token_files.write_records(frame(spark, texts), f"{folder}/r", BYTES, wide=wide)
    index = token_files.write_index(spark, f"{folder}/r", f"{folder}/i", wide)
    rows, start, theirs = {r.doc_id: r for r in index.collect()}, 0, Tokenizer.from_file(BYTES)
    assert len(rows) == len(texts) and len({r.path for r in rows.values()}) > 1
    for k, t in enumerate(texts):
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 0]
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4")))
        start += len(ids)
    some = token_files.read_by_index(spark, f"{folder}/r", index.where("doc_id % 3 = 1"), wide, F.xxhash64("doc_id")).collect()
    assert sorted(r.doc_id for r in some) == [k for k in range(len(texts)) if k % 3 == 1]
    assert all(np.frombuffer(r.ids, "<u4").tolist() == [*theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0] for r in some)


def test_empty_table_of_records(spark, folder):
    token_files.write_records(frame(spark, ["x"]).limit(0), f"{folder}/r", BYTES)
    assert token_files.offset_index(spark, f"{folder}/r").collect() == []


def test_broken_record_is_noticed():
    good = bytearray(token_files.frame(b"12345678abcd"))
    assert bytes(token_files.unframe(memoryview(bytes(good)), 0)[0]) == b"12345678abcd"
    for at in (0, 9, 15, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unframe(memoryview(bytes(bad)), 0)


def test_the_query_reads_totals_from_counts_at_prefixes(spark, sf):
    df = token_counts.op8_token_counts(spark, sf)
    assert "counts" in df._jdf.queryExecution().optimizedPlan().toString()
    operator = token_counts.prefix_counts(spark.read.parquet(f"{sf}/documents.parquet"), token_counts.public_tokenizers.path("piece_bpe_32k.model"), stored=False)
    assert {r.doc_id: r.n_tokens for r in df.collect()} == {r.doc_id: r.n_tokens for r in operator.collect()}


def test_offsets_follow_documents_beyond_100000_files(spark, tmp_path):
    for name, doc in (("part-10001-x.txt", 1), ("part-100000-x.txt", 2)):
        (tmp_path / name).write_bytes(token_files.frame(doc.to_bytes(8, "little") + b"\1\0" * doc))
    got = token_files.offset_index(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.start, r.n_tokens) for r in got} == {(1, 0, 1), (2, 1, 2)}
