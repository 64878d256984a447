"""The memory that rows take on their way to the Python workers."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from smeltry.llm import common, jaccard_join


@pytest.fixture()
def unset(spark):
    spark.conf.unset(common._BATCH)
    yield spark
    spark.conf.unset(common._BATCH)


def largest_batch(docs):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    return docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def test_long_texts_come_in_small_batches(unset, sf):
    spark = unset
    docs = spark.range(400).coalesce(1).selectExpr("id as doc_id", "repeat(cast(id as string), 50000) as text", "'en' as lang", "'s' as source", "1L as n_chars")
    assert largest_batch(docs) > 32 << 20
    for stage in [jaccard_join.classes, *[lambda df, f=f: f(spark, df, sf) for k, (_, f) in enumerate(corpus_pipeline.STAGES) if k != 3]]:  # decontamination has no Python
        spark.conf.unset(common._BATCH)
        stage(docs.limit(2))
        assert largest_batch(docs) < 6 << 20


def test_a_bound_of_the_session_stays(unset):
    unset.conf.set(common._BATCH, "1m")
    common.small_batches(unset)
    assert unset.conf.get(common._BATCH) == "1m"
