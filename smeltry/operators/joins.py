"""Join operators.

No side is ever hinted to broadcast: Spark broadcasts below its own size
threshold, from statistics or from AQE's measured size, and sort-merges above
it. A hot key on the large side is split by AQE; ``salted_join`` does the same
where AQE may not act (inside streams, or under a clustering it must keep).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smeltry.functions import columns as C


def new_keys(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``incoming`` that ``existing`` lacks."""
    return incoming.select(*keys).distinct().join(
        existing.select(*keys), list(keys), "left_anti"
    )


def known_keys(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``incoming`` that ``existing`` has."""
    return incoming.select(*keys).distinct().join(
        existing.select(*keys), list(keys), "left_semi"
    )


def changed_rows(
    incoming: DataFrame, current: DataFrame, keys: Sequence[str], attrs: Sequence[str],
    carry: Sequence[str] = (),
) -> DataFrame:
    """Incoming rows whose attributes differ from the current row of the same key.

    NULL against a value counts as a change. ``carry`` names columns of
    ``current`` to add, prefixed by ``current_``.
    """
    cur = current.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(a).alias(f"_c_{a}") for a in attrs],
        *[F.col(c).alias(f"current_{c}") for c in carry],
    )
    same_key = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    changed = C.any_of([C.differs(F.col(a), F.col(f"_c_{a}")) for a in attrs])
    return incoming.join(cur, same_key, "inner").filter(changed).select(
        *keys, *attrs, *[f"current_{c}" for c in carry]
    )


def temporal_join(
    facts: DataFrame, dim: DataFrame, key: str, ts: str, take: Sequence[str], history: bool = False,
    salts: int = 1,
) -> DataFrame:
    """Left join each fact to the dimension version valid on its day.

    By default only current versions match, with both bounds included. With
    ``history`` every version can match and the end bound is excluded, so that
    a day on which one version ends and the next begins has one match; facts then
    meet only versions of their month, see ``interval_join``.
    """
    day = F.to_date(F.col(ts))
    end = F.coalesce(F.col("effective_end_date"), F.lit(C.OPEN_END))
    versions = dim if history else dim.filter("is_current")
    right = versions.select(
        F.col(key).alias("_key"), F.col("effective_start_date").alias("_from"),
        end.alias("_to"), *take,
    )
    upper = day < F.col("_to") if history else day <= F.col("_to")
    valid = (day >= F.col("_from")) & upper
    if history and salts == 1:
        return interval_join(facts, right, key, day, take)
    if salts > 1:
        joined = salted_join(facts, right, key, "_key", "left", salts, valid)
    else:
        joined = facts.join(right, (F.col(key) == F.col("_key")) & valid, "left")
    return joined.drop("_key", "_from", "_to")


def interval_join(facts: DataFrame, versions: DataFrame, key: str, day: Column, take: Sequence[str]) -> DataFrame:
    """Left join of facts to the versions (_key, _from, _to, *take) with ``_from <= day < _to``.

    A range can't be a join key, and a key with many versions would meet all of them
    with each of its facts. So a closed version stands in a bin for each month it
    covers, and facts look up (key, month). Versions without an end would fill bins
    for ever: they have one of their own, by key alone. A bin is one row that holds its
    versions, as many as begin or last in a month of one key, and the exact bounds are
    checked inside it: a fact is shuffled once for each lookup, whatever the history's
    length. All versions that hold a day match; facts without one keep their row.
    """
    version = F.struct("_from", "_to", *take)
    lasting = versions.filter(F.col("_key").isNotNull() & (F.col("_from") < F.col("_to")))
    closed = F.col("_to") < F.lit(C.OPEN_END)
    months = F.sequence(F.trunc("_from", "month"), F.trunc(F.date_sub("_to", 1), "month"), F.expr("interval 1 month"))
    by_month = (
        lasting.filter(closed).select("_key", F.explode(months).alias("_month"), version.alias("v"))
        .groupBy("_key", "_month").agg(F.collect_list("v").alias("_closed"))
    )
    by_key = lasting.filter(~closed).groupBy(F.col("_key").alias("_open_key")).agg(F.collect_list(version).alias("_open"))
    binned = facts.withColumns({"_day": day, "_bin": F.trunc(day, "month")})
    joined = binned.join(by_month, (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_month")), "left").join(
        by_key, F.col(key) == F.col("_open_key"), "left"
    )
    held = F.concat(*[F.coalesce(c, F.array().cast(joined.schema[c].dataType)) for c in ("_closed", "_open")])
    hits = F.filter(held, lambda v: (v["_from"] <= F.col("_day")) & (F.col("_day") < v["_to"]))
    return joined.withColumn("_hits", hits).select(*facts.columns, F.inline_outer("_hits")).drop("_from", "_to")


def salted_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str,
    salts: int, condition=None, hot_share: float = 0.01,
) -> DataFrame:
    """Inner or left join that splits the hot keys of the left side.

    A key is hot when it holds at least ``hot_share`` of the left rows, so there
    are at most ``1 / hot_share`` hot keys, whatever the data size. Their left
    rows are spread over ``salts`` tasks by the row's hash and their right rows
    repeated once per salt; all other keys keep salt 0. Rows without a key match
    nothing and are spread as well. The hot keys reach the tasks as one list, so
    that neither side is shuffled to be told of them.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left")
    spread = [c for c in left.columns if "map<" not in dict(left.dtypes)[c]]
    dealt = left.withColumn("_spread", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    # Counted with the spread, which takes the columns that the join takes, so that shuffles below are reused.
    counts = (
        dealt.groupBy(F.col(left_key).alias("_hot"), "_spread").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("_hot").agg(F.sum("_n").alias("_n"))
    )
    total = counts.agg(F.sum("_n").alias("n"))
    hot = (
        counts.filter(F.col("_hot").isNotNull() & (F.col("_n") >= total.scalar() * hot_share))
        .agg(F.collect_list("_hot").alias("hot")).scalar()
    )
    salted_left = dealt.withColumn(
        "_salt",
        F.when(F.array_contains(hot, F.col(left_key)) | F.col(left_key).isNull(), F.col("_spread"))
        .otherwise(F.lit(0).cast("bigint")),
    ).drop("_spread")
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    salted_right = right.withColumn(
        "_rsalt",
        F.explode(
            F.when(F.array_contains(hot, F.col(right_key)), every)
            .otherwise(F.array(F.lit(0).cast("bigint")))
        ),
    )
    on = (F.col(left_key) == F.col(right_key)) & (F.col("_salt") == F.col("_rsalt"))
    if condition is not None:
        on = on & condition
    return salted_left.join(salted_right, on, how).drop("_salt", "_rsalt")


def orphans(df: DataFrame, fk: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Foreign key values without a parent, with the number of rows holding them.

    Rows are counted per value first, so a hot value crosses the network once.
    History tables are reduced to their current rows.
    """
    pk = parent_key or (fk if fk in parent.columns else parent.columns[0])
    if "is_current" in parent.columns:
        parent = parent.filter("is_current")
    counts = df.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(
        parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti"
    )
