"""Removal of word sequences that an earlier document has too.

A window is `WINDOW` consecutive words of one document. The suffixes of all texts,
cut at that depth, form a tree whose nodes of full depth are the repeated windows. It
is built in parts that fit in memory: suffixes are split by a prefix of their words,
and each part is a subtree, built by sorting its suffixes and comparing neighbours.

* First, suffixes that can't repeat are left out. Every window contains an anchor, the
  six-word piece of smallest hash in it; equal windows have equal anchors. Only
  anchors that occur in more than one text go on.
* A group is one anchor with the windows around it: for each place of the anchor in
  the window the suffixes that begin there. An anchor of more than `MANY` texts is
  split by a longer prefix, the whole window, and then read as a stream. Words that a
  text repeats are one row, with all their places.
* In each subtree a node of full depth has the smallest document of its suffixes;
  windows of larger documents are removed. Overlapping windows join into one span, so
  a repeat of any length is removed as a whole.

Equal texts are one text, of the smallest key; in later copies every window is
removed. Null texts have no words. Rows with a null key are neither compared nor
changed. Rows of one key with different texts are one document's, and don't remove
from each other. Words are runs of anything but the six ASCII white-space characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smeltry.llm.common import table, written
from smeltry.llm.sentence_pieces import _slices
from smeltry.llm.word_hashes import mixed, word_hashes

WINDOW = 13
#: Words of an anchor.
ANCHOR = 6
#: Places in a window at which its anchor can be.
PLACES = WINDOW - ANCHOR + 1
#: Texts of an anchor beyond which its suffixes are split by the whole window.
MANY = 50_000
#: Suffixes sorted at once: a subtree, or several small ones.
AT_ONCE = 100_000
#: Texts that a task remembers to have read already.
SEEN = 1_000_000
_POWERS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def _sums(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    total = h[:n] * _POWERS[0]
    for k in range(1, size):
        total += h[k : k + n] * _POWERS[k]
    return total


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): each anchor of a text with the range of windows it stands for.

    Windows of one anchor are consecutive, so the ranges follow each other.
    """
    if len(h) < WINDOW:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    piece = mixed(_sums(h, ANCHOR), 17)
    n = len(h) - WINDOW + 1
    least, at = piece[:n].copy(), np.arange(n)
    for k in range(1, PLACES):
        smaller = piece[k : k + n] < least
        least = np.where(smaller, piece[k : k + n], least)
        at = np.where(smaller, np.arange(k, k + n), at)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return piece[at[first]], at[first], first, np.append(first[1:], n) - 1


def _source(docs: DataFrame, key: str, text: str, carry: bool = False) -> DataFrame:
    t = F.col(text).cast("string")
    rest = F.struct(*[c for c in docs.columns if c != text])
    return docs.select(*[rest.alias("row")] * carry, F.col(key).cast("long").alias("key"), t.alias("text"), F.xxhash64(t).alias("text_id"), F.length(t).alias("n_chars"))


def _anchor_rows(source: DataFrame) -> DataFrame:
    """(anchor, text_id): the distinct anchors of every text, once for each task that meets it."""

    def run(batches):
        seen: set[int] = set()
        for part in _slices(batches):
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(2)]
            for t, i in zip(part.column("text").to_pylist(), part.column("text_id").to_pylist(), strict=True):
                if not t or i in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(i)
                anchor = np.unique(anchors(word_hashes(t.encode()))[0]).view(np.int64)
                out[0].append(anchor)
                out[1].append(np.full(len(anchor), i))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["anchor", "text_id"])

    return source.where("key is not null").select("text", "text_id").mapInArrow(run, "anchor long, text_id long")


def _suffixes(flagged: DataFrame) -> DataFrame:
    """Rows (prefix, key, text_id, firsts, back, n, words): the windows around the anchors in `shared`.

    firsts: the first window, at every place of the text where the row's words stand;
    back: words from it to the anchor; n: windows; words: hashes of the n + 12 words. A
    deep anchor gives a row for each window.
    """

    def run(batches):
        for part in _slices(batches):
            rows: list[tuple] = []
            columns = [part.column(c).to_pylist() for c in ("key", "text_id", "text", "shared", "deep")]
            for key, i, t, shared, deep in zip(*columns, strict=True):
                h = word_hashes(t.encode())
                anchor, at, first, last = anchors(h)
                anchor, whole = anchor.view(np.int64), set(deep)
                window = mixed(_sums(h, WINDOW), 19).view(np.int64) if whole else None
                found: dict[tuple, list[int]] = {}
                for k in np.flatnonzero(np.isin(anchor, np.asarray(shared, np.int64))).tolist():
                    f, b, p, prefix = int(first[k]), int(last[k]), int(at[k]), int(anchor[k])
                    if prefix in whole:
                        for s in range(f, b + 1):
                            found.setdefault((int(window[s]), -1, 1, h[s : s + WINDOW].tobytes()), []).append(s)
                    else:
                        found.setdefault((prefix, p - f, b - f + 1, h[f : b + WINDOW].tobytes()), []).append(f)
                rows += [(prefix, key, i, firsts, back, n, words) for (prefix, back, n, words), firsts in found.items()]
                if len(rows) > 5000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    def _batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = [*[pa.int64()] * 3, pa.list_(pa.int64()), *[pa.int64()] * 2, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["prefix", "key", "text_id", "firsts", "back", "n", "words"])

    return flagged.mapInArrow(run, "prefix long, key long, text_id long, firsts array<long>, back long, n long, words binary")


def subtree(prefix: np.ndarray, key: np.ndarray, back: np.ndarray, n: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bit mask for each row: the windows that a smaller key has too. words: all rows' words in a row.

    Suffixes are sorted by prefix, place of the anchor and words; neighbours that share
    all words are one node of full depth.
    """
    row = np.repeat(np.arange(len(key)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1))[row] + step
    suffix = words[start[:, None] + np.arange(WINDOW)]
    place, group = back[row] - step, prefix[row]
    order = np.lexsort((*suffix.T[::-1], place, group))
    suffix, place, group, keys = suffix[order], place[order], group[order], key[row][order]
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (place[1:] != place[:-1]) | (suffix[1:] != suffix[:-1]).any(axis=1)))
    least = np.minimum.reduceat(keys, np.flatnonzero(new))[np.cumsum(new) - 1]
    later = np.zeros(len(row), np.int64)
    later[order] = keys > least
    return np.bitwise_or.reduceat(later << step, np.cumsum(n) - n)


def _repeats(suffixes: DataFrame) -> DataFrame:
    """(text_id, firsts, mask): windows that an earlier document has too."""

    def flush(rows):
        columns = [np.array([r[k] for r in rows], np.int64) for k in (0, 1, 4, 5)]
        return subtree(*columns, np.frombuffer(b"".join(r[6] for r in rows), np.uint64))

    def result(rows, mask):
        hit = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array([rows[k][2] for k in hit], pa.int64()), pa.array([rows[k][3] for k in hit], pa.list_(pa.int64())), pa.array(mask[hit], pa.int64())], ["text_id", "firsts", "mask"])

    def run(batches):
        held: list[tuple] = []
        windows, last, words, least = 0, None, b"", 0
        for batch in batches:
            deep: list[tuple] = []
            for r in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if r[4] < 0:  # a split group: equal windows follow each other, smallest key first
                    if (r[0], r[6]) != (last, words):
                        last, words, least = r[0], r[6], r[1]
                    elif r[1] > least:
                        deep.append(r)
                    continue
                if windows >= AT_ONCE and r[0] != held[-1][0]:
                    yield result(held, flush(held))
                    held, windows = [], 0
                held.append(r)
                windows += r[5]
            if deep:
                yield result(deep, np.ones(len(deep), np.int64))
        if held:
            yield result(held, flush(held))

    return suffixes.repartition("prefix").sortWithinPartitions("prefix", "back", "words", "key").mapInArrow(run, "text_id long, firsts array<long>, mask long")


def covered(n_words: int, windows: list[int]) -> np.ndarray:
    """Which words the windows that start there cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in windows:
        edge[s] += 1
        edge[min(s + WINDOW, n_words)] -= 1
    return np.cumsum(edge)[:-1] > 0


def _marked(docs: DataFrame, key: str, text: str, carry: bool = False) -> DataFrame:
    """key, text, and the windows to remove: `starts` (firsts, mask), or all of them where `copy`; the other columns as `row` if carried."""
    source = _source(docs, key, text)
    by_anchor = Window.partitionBy("anchor")
    known = _anchor_rows(source).withColumns({"lo": F.min("text_id").over(by_anchor), "hi": F.max("text_id").over(by_anchor), "many": F.count(F.lit(1)).over(by_anchor) > MANY})
    flags = known.where("lo <> hi").groupBy("text_id").agg(
        F.collect_set("anchor").alias("shared"), F.collect_set(F.when(F.col("many"), F.col("anchor"))).alias("deep")
    )
    least = source.where("key is not null").groupBy("text_id", "n_chars").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("rows"))
    facts = written(least.join(flags, "text_id", "left").where("rows > 1 or shared is not null"))
    flagged = source.join(facts.where("shared is not null"), ["text_id", "n_chars"]).where(F.col("key") == F.col("least"))
    found = _repeats(_suffixes(flagged.select("key", "text_id", "text", "shared", "deep")))
    starts = found.groupBy("text_id").agg(F.collect_set(F.struct("firsts", "mask")).alias("starts"))
    marks = facts.select("text_id", "n_chars", "least").join(starts, "text_id", "left")
    out = _source(docs, key, text, carry).join(marks, ["text_id", "n_chars"], "left")
    return out.select(*["row"] * carry, "key", "text", "starts", F.coalesce(F.col("key") > F.col("least"), F.lit(False)).alias("copy"))


def removed_words(t: str | None, starts: list[dict] | None, copy: bool) -> tuple[list[bytes], np.ndarray]:
    """Words of a text and which of them are removed."""
    words = (t or "").encode().split()
    n = len(words) - WINDOW + 1
    if copy:
        return words, np.full(len(words), n > 0)
    windows = [f + k for s in starts or () for k in range(PLACES) if s["mask"] >> k & 1 for f in s["firsts"]]
    return words, covered(len(words), windows)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept (words joined by a space), kept_sha256 and spans of removed words (0-based, end excluded) of every row."""

    def run(batches):
        for part in _slices(batches):
            rows = []
            for t, starts, copy in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "copy")), strict=True):
                words, gone = removed_words(t, starts, copy)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                spans = [{"from": a, "to": b} for a, b in edge.reshape(-1, 2).tolist()]
                rows.append((len(words), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest(), spans))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["key", "n_words", "n_removed", "kept", "kept_sha256", "spans"])

    out = _marked(docs, key, text).mapInArrow(run, "key long, n_words long, n_removed long, kept string, kept_sha256 string, spans array<struct<from: long, to: long>>")
    return out.withColumnRenamed("key", key)


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents, with their columns, without repeated words; those that lose all their words go.

    A text that loses none stays as it is; else it is its kept words joined by a space.
    """

    def run(batches):
        for part in _slices(batches):
            texts: list[str | None] = []
            for t, starts, copy in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "copy")), strict=True):
                words, gone = removed_words(t, starts, copy)
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                texts.append(t if len(left) == len(words) else b" ".join(left).decode() if left else None)
            gone_whole = [x is None and t is not None for x, t in zip(texts, part.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(gone_whole, pa.bool_())], ["row", "new", "gone"])

    marked = _marked(docs, key, text, carry=True)
    out = marked.mapInArrow(run, f"row {marked.schema['row'].dataType.simpleString()}, new string, gone boolean").where("not gone")
    changed = {text: F.col("new"), n_chars: F.length("new").cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
