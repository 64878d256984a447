"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide link counts.

Both tokenizers cut a text into byte ranges. Their ends are two ascending arrays, and
an end that both have closes a group. The arrays are walked by diagonal run skipping:
while ends agree at the current shift between the two indices, the stretch is probed in
steps of 8, 16, 32, ... ends, compared as blocks of memory, and its exact length is that
of the first word that differs in the step that failed. Where ends differ, only that group is resolved, end by
end, and the shift is updated. So a one-to-one stretch costs a number of steps that grows as the logarithm of its length.

A link is a pair of occurrences whose ranges end together. Links are counted over the
corpus by id pair: a document sends each of its pairs once. The counts come back to the
documents by a join whose broadcast side is the most frequent pairs, at most
BROADCAST_PAIRS; the rarer ones are joined by shuffle, and none of those is hot.

Texts that are null or empty, or whose joined tokens differ from a space and the text in
either tokenizer (a text with U+2581, for instance), have no tokens: all counts are 0 and
the digest of groups is ''. Each row of the input gives one row, repeated rows and null
keys included; other columns are left out, whatever their names. An empty table gives an
empty result. A very long text is one row of its worker, at some 40 bytes of memory a token.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smeltry.llm.common import table, written
from smeltry.llm.sentence_pieces import _slices

#: Id pairs that are looked up by broadcast, at some 40 bytes each.
BROADCAST_PAIRS = 1_000_000
#: Words in a worker's table before it is begun anew, which changes no result.
REMEMBER = 250_000
SPACE = "▁"

# White space but for the space and the line end, and characters that some libraries take for it.
_OTHER_WHITE = [*"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 ᠎    　​﻿", *map(chr, range(0x2000, 0x200B))]
_RUNS = ("  ", "\n\n", " \n", "\n ")


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in a and b of the ends that both have, by diagonal run skipping.

    a and b are ascending int64 arrays; their last ends need not agree.
    """
    kind = np.int32 if max(a[-1:].sum(), b[-1:].sum()) < 1 << 31 else np.int64
    width, bits = np.dtype(kind).itemsize, 8 * np.dtype(kind).itemsize
    x, y, raw_x, raw_y = a.tolist(), b.tolist(), a.astype(kind).tobytes(), b.astype(kind).tobytes()
    n, m, i, shift = len(x), len(y), 0, 0
    at_a: list[int] = []
    at_b: list[int] = []
    lengths: list[int] = []
    while i < n and i + shift < m:
        j = i + shift
        if x[i] != y[j]:  # an irregular group: resolved end by end
            while i < n and j < m and x[i] != y[j]:
                if x[i] < y[j]:
                    i += 1
                else:
                    j += 1
            shift = j - i
            continue
        p, q, step = width * (i + 1), width * (j + 1), 8 * width
        while True:
            one, two = raw_x[p : p + step], raw_y[q : q + step]
            if one != two:  # the first word that differs; behind the end of an array any word does
                apart = int.from_bytes(one, "little") ^ int.from_bytes(two, "little")
                p += ((apart & -apart).bit_length() - 1) // bits * width
                break
            if not one:
                break
            p += len(one)
            q += len(one)
            step *= 2
        known = p // width - i
        at_a.append(i)
        at_b.append(j)
        lengths.append(known)
        i += known
    size = np.array(lengths, np.int64)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.array(at_a, np.int64), size) + inside, np.repeat(np.array(at_b, np.int64), size) + inside


class Pair:
    """Two tokenizers: a byte-level one of a .json file (A) and a piece model (B)."""

    def __init__(self, json_file: str, model_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(json_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_file)
        letters = _byte_letters()
        self.size_a, self.size_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        raw_a = [bytes(letters[c] for c in t) if (t := self.a.id_to_token(i)) and all(c in letters for c in t) else b"" for i in range(self.size_a)]
        raw_b = [self._raw(i) for i in range(self.size_b)]
        self.raw_a, self.raw_b = raw_a, raw_b
        self.len_a, self.len_b = (np.array([len(t) for t in r], np.int64) for r in (raw_a, raw_b))
        # a group in print: ids of A, a bar, ids of B, a semicolon
        self.print = [b"%d%c" % (i, c) for n, last in ((self.size_a, b"|"), (self.size_b, b";")) for i in range(n) for c in (b",", last)]
        #: Packed ids of words by A and B, None where their bytes aren't the word's; the table before is kept.
        self.words: dict[str, tuple[bytes, bytes] | None] = {}
        self.before: dict[str, tuple[bytes, bytes] | None] = {}
        with open(json_file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        spans = any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces)
        #: Whether texts may be encoded word by word: no token of either spans a space or line end between words.
        self.by_words = not spans and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.space = self.b.piece_to_id(SPACE)

    def _raw(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def simple(self, text: str) -> bool:
        """Whether single spaces and single line ends are all the white space, between words."""
        return self.by_words and SPACE not in text and text[0] not in " \n" and text[-1] not in " \n" and not any(r in text for r in _RUNS) and not any(c in text for c in _OTHER_WHITE)

    def _learn(self, new: list[str]) -> None:
        """Enters words into the table. A takes them as one text, in which each word's bytes are known."""
        spaced = [w if w[0] == "\n" else " " + w for w in new]
        data = [w.encode() for w in spaced]
        one = np.asarray(self.a.encode("".join(spaced), add_special_tokens=False).ids, np.uint32)
        bounds, ends = np.cumsum([len(d) for d in data]), np.cumsum(self.len_a[one])
        behind = np.searchsorted(ends, bounds) + 1
        # no space stands behind a line end
        two = [q[1:] if w[0] == "\n" else q for w, q in zip(new, self.b.encode(new, num_threads=1), strict=True)]
        flat, whole = [i for q in two for i in q], b"".join(data)
        fine = b"".join(map(self.raw_a.__getitem__, one.tolist())) == whole == b"".join(map(self.raw_b.__getitem__, flat)) and np.array_equal(ends[behind - 1], bounds)
        fine = fine and np.array_equal(np.append(0, np.cumsum(self.len_b[flat]))[np.cumsum([len(q) for q in two])], bounds)
        packed, first = one.tobytes(), 0
        for w, d, last, q in zip(new, data, (4 * behind).tolist(), two, strict=True):
            p = packed[first:last]
            first = last
            same = fine or b"".join(map(self.raw_a.__getitem__, memoryview(p).cast("I"))) == d == b"".join(map(self.raw_b.__getitem__, q))
            self.words[w] = (p, _packed(q)) if same else None

    def ids(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of each text by A and B as packed 32-bit integers; None where their bytes aren't a space and the text."""
        cut = [t.replace("\n", " \n").split(" ") if self.simple(t) else None for t in texts]
        if len(self.words) > REMEMBER:
            self.before, self.words = self.words, {}
        known = self.words
        new = set().union(*filter(None, cut)).difference(known)
        old = new & self.before.keys()
        known.update((w, self.before[w]) for w in old)
        if new := list(new - old):
            self._learn(new)
        return [self._whole(t) if words is None else self._joined(list(map(known.__getitem__, words))) for t, words in zip(texts, cut, strict=True)]

    @staticmethod
    def _joined(found: list[tuple[bytes, bytes] | None]) -> tuple[bytes, bytes] | None:
        return None if None in found else (b"".join([f[0] for f in found]), b"".join([f[1] for f in found]))

    def _whole(self, text: str) -> tuple[bytes, bytes] | None:
        a, b, data = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), b" " + text.encode()
        return (_packed(a), _packed(b)) if b"".join(map(self.raw_a.__getitem__, a)) == data == b"".join(map(self.raw_b.__getitem__, b)) else None

    def aligned(self, packed: tuple[bytes, bytes]) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, digest of the groups, distinct id pairs of links and how often each is there."""
        a, b = (np.frombuffer(x, np.uint32).astype(np.int64) for x in packed)
        in_a, in_b = common_ends(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[in_a], last_b[in_b] = 1, 1
        # in print, a group's tokens of A stand before those of B
        before_b = np.concatenate(([0], in_b + 1))[np.cumsum(last_a) - last_a]
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + before_b] = 2 * a + last_a
        codes[np.arange(len(b)) + in_a[np.cumsum(last_b) - last_b] + 1] = 2 * (self.size_a + b) + last_b
        groups = b"".join(map(self.print.__getitem__, codes.tolist()))[:-1]
        pairs, times = np.unique(a[in_a] * self.size_b + b[in_b], return_counts=True)
        return len(a), len(b), len(in_a), hashlib.sha256(groups).hexdigest(), pairs, times


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _byte_letters() -> dict[str, int]:
    """Byte of each byte-level letter: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(rest)): b for b in range(256)}


@lru_cache(maxsize=2)
def load(json_file: str, model_file: str) -> Pair:
    """One pair for each worker process and pair of files."""
    return Pair(json_file, model_file)


_COUNTS = ["n_a", "n_b", "n_groups"]


def aligned(df: DataFrame, json_file: str, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row (a number of the row's own), n_a, n_b, n_groups, groups_sha256, and each id pair of its links once.

    pairs holds id of A * pieces of B + id of B, times how often each is linked.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    both = load(json_file, model_file)
    wide = both.size_a * both.size_b > 1 << 31
    code = pa.int64() if wide else pa.int32()

    def run(batches):
        own, seen = load(json_file, model_file), TaskContext.get().partitionId() << 33
        nothing = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        for part in _slices(batches):
            texts = part.column("text").to_pylist()
            packed = iter(own.ids([t for t in texts if t]))
            rows = [own.aligned(p) if t and (p := next(packed)) else nothing for t in texts]
            n_a, n_b, n_groups, digest, pairs, times = zip(*rows, strict=True)
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), pa.array(np.concatenate(x), k)) for x, k in ((pairs, code), (times, pa.int32()))]
            number = pa.array(np.arange(seen, seen + len(rows)))
            seen += len(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), number, *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups)), pa.array(digest), *lists],
                ["key", "row", *_COUNTS, "groups_sha256", "pairs", "times"],
            )

    array = "array<bigint>" if wide else "array<int>"
    schema = f"key {kind}, row long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs {array}, times array<int>"
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def link_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """pair, b, n (links of the corpus that hold it) and best (whether n is the highest of its id of B)."""
    each = rows.select(F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    counts = written(each.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", (F.col("pair") % size_b).cast("int")))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return written(counts.join(top, "b").select("pair", "b", "n", (F.col("n") == F.col("top")).alias("best")))


def _with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """row, times, n and best of every pair of every row."""
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    counts = counts.drop("b")
    total = counts.count()
    if total <= BROADCAST_PAIRS:
        return each.join(F.broadcast(counts), "pair").drop("pair")
    # the frequent pairs go by broadcast: what is left for the shuffle has no hot pair
    steps = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()}
    power, left = max(steps) + 1, BROADCAST_PAIRS
    while power and steps.get(power - 1, 0) <= left:
        power -= 1
        left -= steps.get(power, 0)
    frequent = counts.where(F.col("n") >= 1 << power).withColumnsRenamed({"n": "n_f", "best": "best_f"})
    rare = counts.where(F.col("n") < 1 << power)
    marked = each.join(F.broadcast(frequent), "pair", "left")
    found = marked.where("n_f IS NOT NULL").select("row", "times", F.col("n_f").alias("n"), F.col("best_f").alias("best"))
    return found.union(marked.where("n_f IS NULL").select("row", "pair", "times").join(rare.hint("merge"), "pair").select("row", "times", "n", "best"))


def alignment(df: DataFrame, json_file: str, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    rows = written(aligned(df, json_file, model_file, key, text))
    counts = link_counts(rows, load(json_file, model_file).size_b)
    sums = _with_counts(rows, counts).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    # every end that both have is a link, so there are as many as groups
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        key, *_COUNTS, F.col("n_groups").alias("n_links"), zero("best").alias("n_best"), zero("total").alias("count_sum"), "groups_sha256"
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
