"""Shards of near-equal bytes by a k-d tree over metadata.

The tree splits every node along its widest dimension (range within the node over
range in all rows) at the byte-weighted median, until leaves reach the target bytes.
Medians are found for all nodes of a level together, by radix refinement: sums of
bytes by the next 16 bits of the sort key, then only within the bin that holds the
median. The key ends in hash bits of the row, so a value shared by a third of all
rows is split too. Only one row for each node comes to the driver, which the number
of leaves bounds. Texts are read once, for their size and checksum; they aren't moved.

Nulls: a null text has size 1 (its end mark) and checksum 0; null metadata counts as 0.
Equal rows may share a key and then stay together. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smeltry.llm.common import shuffle_partitions, spread, table, written

#: Bits of one refinement, of the scaled value and of the tie breaker.
RADIX, VALUE_BITS, TIE_BITS = 16, 31, 32
#: Share of a node's bytes within which a cut is near enough to the median.
TOLERANCE = 0.0002
#: Rows that one task numbers.
SLOT_ROWS = 100_000


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """rows with a string column replaced by its rank among the distinct values; null is 0. Values are numbered by ranges, not in one task."""
    values = rows.select(F.col(name).alias("value")).where("value is not null").distinct()
    values = written(values.repartitionByRange(shuffle_partitions(rows.sparkSession), "value").withColumn("part", F.spark_partition_id()))
    counts = values.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    ranks = values.join(before, "part").select("value", (F.col("before") + at).cast("long").alias("rank"))
    return rows.join(ranks, F.col(name) == F.col("value"), "left").withColumn(name, F.coalesce("rank", F.lit(0).cast("long"))).drop("value", "rank")


def magnitude(c: Column) -> Column:
    """A number that grows with the logarithm of a size; null is 0."""
    return F.coalesce((F.log2(c.cast("double") + 1) * 1_000_000).cast("long"), F.lit(0).cast("long"))


def leaves(rows: DataFrame, dims: list[str], target_bytes: int, size: str = "size", tie: str = "tie") -> DataFrame:
    """rows with `leaf`, numbered from 0 in tree order. rows is read several times: pass a written table."""
    spark = rows.sparkSession
    bounds = rows.agg(F.sum(size), *[f(d).cast("long") for d in dims for f in (F.min, F.max)]).first()
    total = bounds[0] or 0
    levels = max(0, math.ceil(math.log2(total / target_bytes))) if total else 0
    spans = {d: max(1, bounds[2 + 2 * k] - bounds[1 + 2 * k]) for k, d in enumerate(dims)} if total else {}
    out = rows.withColumn("leaf", F.pmod(F.col(tie), F.lit(1)).cast("int"))  # 0, but no constant: joins stay joins by key
    for _ in range(levels):
        nodes = out.groupBy("leaf").agg(F.sum(size).alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        plan = []
        for n in nodes:
            d = max(dims, key=lambda d: (n[f"hi_{d}"] - n[f"lo_{d}"]) / spans[d])
            plan.append((n["leaf"], dims.index(d), n[f"lo_{d}"], max(1, n[f"hi_{d}"] - n[f"lo_{d}"]), n["bytes"]))
        node_table = spark.createDataFrame(plan, "leaf int, dim int, lo long, span long, bytes long")
        value = F.element_at(F.array(*[F.col(d) for d in dims]), F.col("dim") + 1)
        scaled = F.floor((value - F.col("lo")) / F.col("span") * (2**VALUE_BITS - 1)).cast("long")
        keyed = out.join(F.broadcast(node_table.select("leaf", "dim", "lo", "span")), "leaf").withColumn(
            "key", F.shiftleft(scaled, TIE_BITS).bitwiseOR(F.shiftrightunsigned(F.col(tie), 64 - TIE_BITS))
        )
        cuts = _cuts(keyed, {n["leaf"]: n["bytes"] for n in nodes}, size)
        cut_table = spark.createDataFrame(list(cuts.items()), "leaf int, cut long")
        out = keyed.join(F.broadcast(cut_table), "leaf").select(*rows.columns, (F.col("leaf") * 2 + (F.col("key") >= F.col("cut")).cast("int")).alias("leaf"))
    return out


def _cuts(keyed: DataFrame, weight: dict[int, int], size: str) -> dict[int, int]:
    """For each node the key from which rows go right: the byte-weighted median."""
    spark = keyed.sparkSession
    prefix = dict.fromkeys(weight, 0)  # the bits found so far
    before = dict.fromkeys(weight, 0)  # bytes of smaller keys
    cuts: dict[int, int] = {}
    for shift in (48, 32, 16, 0):
        open_nodes = spark.createDataFrame([(n, prefix[n], before[n], weight[n] / 2) for n in weight if n not in cuts], "leaf int, prefix long, before long, half double")
        inside = keyed.join(F.broadcast(open_nodes), "leaf")
        if shift < 48:
            inside = inside.where(F.shiftrightunsigned("key", shift + RADIX) == F.col("prefix"))
        bins = inside.groupBy("leaf", "half", "before", F.shiftrightunsigned("key", shift).alias("bin")).agg(F.sum(size).alias("w"))
        order = Window.partitionBy("leaf").orderBy("bin")
        upto = bins.withColumn("upto", F.col("before") + F.sum("w").over(order))
        found = upto.where(F.col("upto") >= F.col("half")).groupBy("leaf").agg(F.min_by(F.struct("bin", "w", "upto"), "bin").alias("b")).collect()
        for r in found:
            n, b = r["leaf"], r["b"]
            prefix[n], before[n] = b["bin"], b["upto"] - b["w"]
            if shift == 0 or b["w"] <= TOLERANCE * weight[n]:
                after = b["upto"] - weight[n] / 2 < weight[n] / 2 - before[n]  # the nearer border of the bin
                cuts[n] = b["bin"] + after << shift
        if len(cuts) == len(weight):
            break
    return cuts


def with_slots(rows: DataFrame, group: str = "shard", tie: str = "tie", order: tuple[str, ...] = ("doc_id",), slots: int | None = None) -> DataFrame:
    """rows with `slot`: numbers from 0 without gaps in each group, of which one may hold most rows."""
    n = slots or shuffle_partitions(rows.sparkSession)
    cells = rows.withColumn("cell", spread(F.col(tie), n, 1))
    counts = cells.groupBy(group, "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(group).orderBy("cell")) - F.col("n")).drop("n")
    numbered = cells.withColumn("at", F.row_number().over(Window.partitionBy(group, "cell").orderBy(tie, *order)) - 1)
    return numbered.join(before, [group, "cell"]).withColumn("slot", (F.col("before") + F.col("at")).cast("long")).drop("cell", "before", "at")


def kd_shards(docs: DataFrame, shards: int = 8, dims: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and slot of every row; the leaves are the shards (a power of two).

    dims: names and numeric expressions of the metadata; by default size, source and language.
    """
    if shards & (shards - 1):
        raise ValueError("halving gives a power of two of shards")
    strings = []
    if dims is None:
        dims, strings = {"d_size": magnitude(F.octet_length(F.col(text))), "d_source": F.col("source").cast("string"), "d_lang": F.col("lang").cast("string")}, ["d_source", "d_lang"]
    rows = written(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"),
            *[c.alias(n) for n, c in dims.items()],
        ).withColumn("tie", F.xxhash64("doc_id", "text_crc32", "size"))
    )
    if strings:
        for name in strings:
            rows = ranked(rows, name)
        rows = written(rows)
    total, n_rows = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    out = leaves(rows, list(dims), max(1, math.ceil((total or 0) / shards))).withColumnRenamed("leaf", "shard")
    slots = max(shuffle_partitions(docs.sparkSession), math.ceil(n_rows / SLOT_ROWS))
    return with_slots(out.drop(*dims), slots=slots).drop("tie").withColumnRenamed("doc_id", key)


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the documents by shard, in slot order within a file; texts move once.

    The folders' column is `shard`, with an underscore behind it where the documents have one.
    """
    shard, slot = "shard", "slot"
    while shard in docs.columns:
        shard += "_"
    while slot in docs.columns:
        slot += "_"
    joined = docs.join(placed.select(key, F.col("shard").alias(shard), F.col("slot").alias(slot)), key)
    ordered = joined.repartition(shard, F.floor(F.col(slot) / SLOT_ROWS)).sortWithinPartitions(shard, slot)
    ordered.write.partitionBy(shard).parquet(path)


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
