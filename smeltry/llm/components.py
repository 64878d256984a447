"""Connected components of links, as a table of the smallest reachable label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smeltry.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) of every id in the links; label is the smallest id of its component.

    Each round takes the smallest label among the neighbours and then follows labels
    once, so chains shorten by half; each round is written. Minima are combined
    map-side, so an id with very many links is no single task's work.
    """
    both = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).distinct())
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        beside = both.join(labels, F.col("v") == F.col("id")).groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        nearest = labels.join(beside, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = written(nearest.join(above, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = step.where("label <> old").limit(1).count()
        labels = step.drop("old")
        if not changed:
            return labels
