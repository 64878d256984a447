"""The pipeline on a given table, and what it does with planted cases."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from smeltry.llm import queries
from smeltry.llm.common import written


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES if k.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES and set(queries.SQL) <= set(queries.QUERIES)


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[5] == counts[4] > 0
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_near_copies_and_benchmark_passages_go(spark, sf):
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    text = " ".join(word(7919 * k % 100003) for k in range(150))
    near = text + " one more"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    leak = " ".join(word(104729 * k % 1000003) for k in range(60)) + " " + item
    docs = spark.createDataFrame([(1, text), (2, near), (3, text), (4, leak)], "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = written(stage(spark, docs, sf))
    assert [r.doc_id for r in docs.collect()] == [1]
