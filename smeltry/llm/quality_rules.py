"""Quality rules learned as a decision list.

Sequential covering on labelled rows: a rule, a conjunction of thresholds on text
statistics, is grown on two thirds of the rows that no rule covers yet, pruned on the
other third, and kept if its smoothed purity there is high enough; then the rows it
covers go and the next rule is grown. The ordered rules become one Spark conditional
expression, so all documents are judged by built-in expressions over the statistics.

Only fitting takes a sample: at most MAX_LABELLED labelled rows, the ones with the
smallest hash of their key. Rows labelled more than once count by their mean label,
null labels not at all. Without usable labels the list is empty and all are kept.
Null and empty texts have zero words, so the base rule rejects them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smeltry.llm.common import table, written
from smeltry.llm.text_stats import text_stats, with_stats

#: Bound of the rows on which rules are fitted; they are held by the driver.
MAX_LABELLED = 20_000
#: Thresholds tried for a feature, conditions in a rule, rules in a list.
CUTS, MAX_CONDITIONS, MAX_RULES = 64, 4, 16
#: Least smoothed purity of a rule on the rows that prune it.
PURITY = 0.8

#: What rules may test, as SQL expressions over the statistics.
FEATURES: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(n_words, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "longest_word": "cast(longest_word as double)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = F.expr(FEATURES[self.feature])
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(and_, (c.holds(x) for c in rule), np.ones(n, bool))


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition of most information gain until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad & inside).any():
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p:
            break
        start, best, choice = np.log2(p / (p + n)), 0.0, None
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1]))
            order = np.argsort(v, kind="stable")
            at = np.searchsorted(v[order], cuts, side="right")
            low_p = np.concatenate(([0], np.cumsum(b[order])))[at]
            for above, ps, ns in ((False, low_p, at - low_p), (True, p - low_p, n - (at - low_p))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - start), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best + 1e-12:
                    best, choice = gain[k], Condition(name, above, float(cuts[k]))
        if choice is None:
            break
        rule.append(choice)
        inside &= choice.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    """The front part of the rule of best worth on other rows, and its smoothed purity there."""
    best: tuple[float, int, float] = (-np.inf, 0, 0.0)
    for k in range(1, len(rule) + 1):
        inside = covered(rule[:k], x, len(bad))
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = worth, k, (p + 1) / (p + n + 2)
    return rule[: best[1]], best[2]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows. fold: 0 and 1 grow, 2 prunes."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        g, t = left & (fold < 2), left & (fold == 2)
        if not (bad & g).any() or not (bad & t).any():
            break
        rule = grow({k: v[g] for k, v in x.items()}, bad[g])
        if not rule:
            break
        rule, purity = prune(rule, {k: v[t] for k, v in x.items()}, bad[t])
        inside = covered(rule, x, len(bad)) & left
        if purity < PURITY or not inside.any():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> list[Rule]:
    """Rules for rows whose mean label is under one half."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("mean"))
    chosen = stats.join(known, F.col(key) == F.col("key")).select(F.xxhash64("key").alias("h"), F.col("mean"), *[F.expr(e).alias(n) for n, e in FEATURES.items()])
    chosen = written(chosen)
    # a share of the hashes that holds about MAX_LABELLED rows, so that each task sends its part of them only
    share = max(1, chosen.count() // MAX_LABELLED)
    rows = chosen.where(F.pmod(F.xxhash64("h"), F.lit(share)) == 0).orderBy("h", *FEATURES).limit(MAX_LABELLED).toPandas()
    if rows.empty:
        return []
    x = {n: rows[n].to_numpy(float) for n in FEATURES}
    return learn(x, rows["mean"].to_numpy(float) < 0.5, rows["h"].to_numpy(np.int64) % 3)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(reduce(and_, (c.column() for c in rules[k - 1])), F.lit(k)).otherwise(out)
    return out.cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def judged(docs: DataFrame, labels: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """doc_id, all statistics, base_failed, rule (0: none holds) and kept of every document."""
    if stats is None:
        stats = written(text_stats(docs))
    rules = fit(stats, labels)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns; a row passes by its own text.

    Statistics are computed once for fitting and again beside the rows, which costs less
    than a shuffle of the texts.
    """
    rules = fit(written(text_stats(docs)), labels)
    return with_stats(docs).where(~base_failed() & (verdict(rules) == 0)).select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
