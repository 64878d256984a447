"""Benchmark decontamination with a hash set of test n-grams, in Spark expressions only.

A window is `size` consecutive words of an item; an item of fewer words is one window.
Any occurrence of a window of m words holds, at one of every s consecutive start
positions, a piece of k words with k + s - 1 = m. So documents are hashed at every
s-th position only, looked up in the hash set of all k-word pieces of the items, and
each hit is verified: words are compared from the piece outwards, and where the match
covers m words or more, all of them are hit.

The set is broadcast if the items have at most BROADCAST_WORDS words, each of which
makes one entry of bounded size; beyond that the look-up is a shuffled join.

Null texts have no words and are never hit; null items have no windows. Rows with
the same key and text give one result row each. Words are runs of ASCII letters and
digits and of everything beyond ASCII, with A-Z lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smeltry.llm.common import table

SIZE = 10
#: Items up to this many words in all are broadcast: about 300 bytes a word.
BROADCAST_WORDS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Normalised words; an empty array for null."""
    split = F.array_remove(F.split(F.translate(text, UPPER, LOWER), _BETWEEN), "")
    return F.coalesce(split, F.array().cast("array<string>"))


def piece_size(m: int) -> tuple[int, int]:
    """Words of the pieces for windows of m words, and the step between hashed positions."""
    k = (m + 1) // 2
    return k, m - k + 1


_PIECE = "struct<m:int,at:int,h:bigint,around:array<string>>"


def _pieces(m: int, at_every: int, size: int) -> Column:
    """(m, at, h, around) for the pieces of `words` at positions 1, 1 + at_every, ...

    around: the 2 * size + 1 words around the first word of the piece, null outside the
    text, so rows made of pieces needn't carry the text. Words are taken one by one: a
    slice of a long array costs the whole array.
    """
    k, _ = piece_size(m)
    last = F.size("words") - k + 1
    word = lambda at: F.when(at >= 1, F.get("words", at - 1))
    one = lambda at: F.struct(
        F.lit(m).alias("m"), at.alias("at"), F.xxhash64(F.array(*[F.get("words", at + j) for j in range(-1, k - 1)]), F.lit(m)).alias("h"),
        F.array(*[word(at + j) for j in range(-size, size + 1)]).alias("around"),
    )
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last, F.lit(at_every)), one)).otherwise(F.array().cast(f"array<{_PIECE}>"))


def _cut(df: DataFrame, text: str, *more: Column) -> DataFrame:
    """More columns and words. These come from a generator: an optimizer that put their
    expression in place of the column would evaluate it again for each piece."""
    return df.select(*more, F.explode(F.array(words(F.col(text)))).alias("words"))


def index_of(items: DataFrame, size: int = SIZE, key: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int], int]:
    """Pieces of all items with their context, the window lengths that occur, and the number of words."""
    cut = _cut(items, text, F.col(key).cast("string").alias("item")).where("size(words) > 0")
    length = F.least(F.size("words"), F.lit(size))
    seen = cut.groupBy(length.alias("m")).agg(F.sum(F.size("words")).alias("n")).collect()
    lengths = sorted(r["m"] for r in seen)
    cut = cut.withColumn("length", length)
    none = F.array().cast(f"array<{_PIECE}>")
    pieces = F.concat(none, *[F.when(F.col("length") == m, _pieces(m, 1, size)).otherwise(none) for m in lengths])
    out = cut.select("item", F.explode(pieces).alias("p")).select("item", F.col("p.m").alias("item_m"), F.col("p.h").alias("item_h"), F.col("p.around").alias("item_words"))
    return out, lengths, sum(r["n"] for r in seen)


def matches(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Of every row: key, text_hash (xxhash64 of the text), n_words, spans (from, to; 1-based words, inclusive) and the items found, as strings."""
    index, lengths, n_words = index_of(items, size, item_key, item_text)
    nothing = F.array(F.struct(F.lit(0).alias("m"), F.lit(0).alias("at"), F.lit(None).cast("bigint").alias("h"), F.array().cast("array<string>").alias("around")))
    cut = _cut(docs, text, F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"))
    # The first entry of a row stands for the row itself, which must not get lost.
    # n is a column before the pieces are made: else every piece would carry the words for it
    looked = cut.withColumn("n", F.size("words")).select("key", "text_hash", "n", F.explode(F.concat(nothing, *[_pieces(m, piece_size(m)[1], size) for m in lengths])).alias("p"))
    looked = looked.select("key", "text_hash", "n", "p.m", "p.at", "p.h", F.col("p.around").alias("own"))
    if n_words <= BROADCAST_WORDS:
        found = looked.join(F.broadcast(index), F.col("h") == F.col("item_h"), "left").where("at = 0 or item is not null")
    else:
        # rows that stand for themselves have nothing to look up: past the shuffle they would meet in one task
        itself = looked.where("at = 0").select(*looked.columns, *[F.lit(None).cast(t).alias(c) for c, t in index.dtypes])
        found = looked.where("at > 0").join(index, F.col("h") == F.col("item_h")).unionByName(itself)

    k = F.floor((F.col("m") + 1) / 2)
    same = lambda j: F.coalesce(F.get("own", j) == F.get("item_words", j), F.lit(False))
    core, left, right = F.lit(True), F.lit(0), F.lit(0)
    for t in range(size - 1, -1, -1):
        core = core & ((F.lit(t) >= k) | same(F.lit(size + t)))
        if t:
            left = F.when((F.lit(t) <= F.col("m") - k) & same(F.lit(size - t)), left + 1).otherwise(0)
            right = F.when((F.lit(t) <= F.col("m") - k) & same((k + size - 1 + t).cast("int")), right + 1).otherwise(0)
    checked = found.select("key", "text_hash", "n", "at", "item", "item_m", "m", k.alias("k"), core.alias("core"), left.alias("l"), right.alias("r"))
    hit = (F.col("at") > 0) & (F.col("m") == F.col("item_m")) & F.col("core") & (F.col("l") + F.col("k") + F.col("r") >= F.col("m"))
    span = F.struct((F.col("at") - F.col("l")).cast("int").alias("from"), (F.col("at") + F.col("k") - 1 + F.col("r")).cast("int").alias("to"))
    rows = checked.where((F.col("at") == 0) | hit).groupBy("key", "text_hash").agg(
        F.sum((F.col("at") == 0).cast("int")).alias("copies"),
        F.max("n").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("at") > 0, span)).alias("spans"),
        F.collect_set(F.when(F.col("at") > 0, F.col("item"))).alias("items"),
    )
    return rows.select(F.col("key").alias(key), "text_hash", "n_words", F.array_sort("spans").alias("spans"), F.array_sort("items").alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def covered_words(spans: Column) -> Column:
    """Words inside at least one of the sorted spans."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(acc["upto"], s["from"] - 1))).alias("n"), F.greatest(acc["upto"], s["to"]).alias("upto")
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), step, lambda acc: acc["n"].cast("long"))


def clean_documents(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents without any hit, with their columns; a row goes by its own text, whatever its key."""
    bad = matches(docs, items, size).where(F.size("items") > 0).select(F.col("doc_id").alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_key")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left_anti").select(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", covered_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )
