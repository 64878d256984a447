"""URL filter by a tree of path templates, in Spark expressions only.

Under each host a tree grows segment by segment. A segment that fewer than LEAST of
its node's URLs share is variable and becomes a wildcard. A frequent segment, however
many others there are, stays a branch of its own only if the labelled share of bad
URLs in it differs statistically from that of its node; similar branches are merged
into one. The tree grows until no node can have a branch. What is left is a set of
templates; each is rejected if its purity, the share of bad among labelled URLs
smoothed towards its host's and all hosts', reaches a threshold. Prefix rules of
hosts and paths override the templates.

A null URL, or one without `://`, has an empty host and path; the template of those
is judged like any other. Segments that all URLs of a node share are passed in one
step, and nodes of fewer than LEAST URLs are finished in one, so there are as many
steps as levels at which frequent paths part or end. Repeated rows each get a row.
Counts are combined map-side before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smeltry.llm.common import table, written
from smeltry.llm.decontaminate import LOWER, UPPER

#: Least URLs of a branch.
LEAST = 5
#: Standard errors by which a branch's labelled share must differ to stay apart.
Z = 2.0
#: Labelled URLs for which the share above a template counts, and the purity that rejects.
WEIGHT, REJECT = 10.0, 0.5
#: Rules of the query: verdict, host, path. Fixed values.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _passed(urls: DataFrame) -> DataFrame:
    """urls whose `rest` begins behind the segments that all URLs of their node share; it is empty where the node can have no branch."""
    node = urls.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    # least and greatest share what all share
    parted = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False)
    shared = F.when(parted > 0, parted - 1).otherwise(F.size("lo")).cast("int")
    node = node.select("host", "template", F.when(F.col("n") >= LEAST, shared).alias("shared"))
    # `+`: a merged branch, `*`: a variable segment
    step = F.coalesce(F.expr("repeat('/+', shared)"), F.expr("repeat('/*', size(rest))"))
    rest = F.expr("slice(rest, coalesce(shared, size(rest)) + 1, size(rest))")
    return urls.join(node, ["host", "template"]).withColumn("template", F.concat("template", step)).withColumn("rest", rest).drop("shared")


def _branched(urls: DataFrame) -> DataFrame:
    """urls one segment further."""
    rows = urls.withColumn("segment", F.get("rest", F.lit(0)))
    child = rows.groupBy("host", "template", "segment").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad_n"))
    node = child.groupBy("host", "template").agg(F.sum("labelled").alias("node_labelled"), F.sum("bad_n").alias("node_bad"))
    p = F.col("node_bad") / F.greatest(F.col("node_labelled"), F.lit(1))
    apart = F.abs(F.col("bad_n") - p * F.col("labelled")) >= Z * F.sqrt(p * (1 - p) * F.col("labelled"))
    common = F.col("n") >= LEAST
    named = child.join(node, ["host", "template"]).where(common).select("host", "template", "segment", F.when((F.col("bad_n") != p * F.col("labelled")) & apart, F.col("segment")).otherwise("+").alias("name"))
    step = F.concat(F.lit("/"), F.coalesce("name", F.lit("*")))
    return rows.join(named, ["host", "template", "segment"], "left").withColumn("template", F.concat("template", step)).withColumn("rest", F.expr("slice(rest, 2, size(rest))")).drop("name", "segment")


def templates(urls: DataFrame) -> DataFrame:
    """urls (id, host, path, bad: 1, 0 or null) with `template`.

    Each step is written, as it is read for counting and for naming. Rows whose path
    has ended leave the loop.
    """
    rows = written(urls.withColumn("rest", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit("")))
    out = rows.where(F.size("rest") == 0)
    step = _passed
    while not (going := rows.where(F.size("rest") > 0)).isEmpty():
        rows = written(step(going))
        out = out.unionByName(rows.where(F.size("rest") == 0))
        step = _branched if step is _passed else _passed
    return out.drop("rest")


def purity(urls: DataFrame) -> DataFrame:
    """host, template, and `purity`: the smoothed share of bad among the labelled URLs."""
    leaf = urls.groupBy("host", "template").agg(F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad_n"))
    host = leaf.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad_n").alias("host_bad"))
    # One row: the share over all hosts, 0 where nothing is labelled.
    overall = host.agg((F.coalesce(F.sum("host_bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("host_labelled"), F.lit(0)), F.lit(1))).alias("overall")).first()[0]
    host_share = (F.col("host_bad") + WEIGHT * overall) / (F.col("host_labelled") + WEIGHT)
    return leaf.join(host, "host").select("host", "template", ((F.col("bad_n") + WEIGHT * host_share) / (F.col("labelled") + WEIGHT)).alias("purity"))


def judged(pages: DataFrame, labels: DataFrame | None, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, template and purity of every row.

    labels: (id, bad) for URLs whose path's last number is that id; several labels of an id count by their mean.
    """
    host, path = parts(F.col(url).cast("string"))
    rows = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    if labels is None:
        rows = rows.withColumn("bad", F.lit(None).cast("int"))
    else:
        known = labels.where("id is not null and bad is not null").groupBy(F.col("id").alias("label_id")).agg((F.avg("bad") >= 0.5).cast("int").alias("bad"))
        number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint)")
        rows = rows.withColumn("label_id", number).join(known, "label_id", "left").drop("label_id")
    rows = written(templates(rows))
    out = rows.join(purity(rows), ["host", "template"])
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise("allow")
    return out.select(F.col("id").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "template", "purity")


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return judged(table(spark, sf_dir, "pages"), labels, RULES)
