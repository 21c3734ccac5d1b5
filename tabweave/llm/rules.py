"""Quality rules: a learned decision list over document statistics.

Sequential covering on labelled rows, of which about ``sample_rows`` at most reach the driver: a rule against the text (a conjunction of thresholds) is
grown by information gain on two thirds of the rows, pruned from its end on the others, and taken if it stays precise
there; the rows it covers leave, and the next rule is grown. The list becomes one ordered conditional expression over
statistic columns, so that applying it is plain column work behind the pass that counts.

Cases: null and empty texts have counts of 0 (and fail the base rule of 50 words); without labelled rows of both kinds
the list is empty and keeps all; repeated rows are judged one by one; other columns of the input are not read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.shared import fold, held_out, store
from tabweave.llm.stats import RATIOS, ratio_columns, with_counts

STATISTICS = ("n_words", *RATIOS)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.statistic]
        return x >= self.threshold if self.above else x < self.threshold

    def column(self) -> Column:
        x = F.col(self.statistic)
        return x >= self.threshold if self.above else x < self.threshold


def _covers(rule: list[Condition], table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    return bad * (np.log2(bad / (bad + good)) - np.log2(bad0 / (bad0 + good0))) if bad else -1.0


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> list[Condition]:
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        b, g, best = int((inside & bad).sum()), int((inside & ~bad).sum()), (0.0, None)
        for name in STATISTICS:
            x = table[name]
            values = np.unique(np.quantile(x[inside & bad], np.linspace(0, 1, cuts)))
            for t in np.unique(np.concatenate((values, np.quantile(x[inside], np.linspace(0, 1, cuts))))):
                high = inside & (x >= t)
                hb, hg = int((high & bad).sum()), int((high & ~bad).sum())
                best = max(best, (_gain(hb, hg, b, g), Condition(name, True, float(t))), (_gain(b - hb, g - hg, b, g), Condition(name, False, float(t))), key=lambda v: v[0])
        if best[1] is None or best[0] <= 1e-9:
            break
        rule.append(best[1])
        inside &= best[1].holds(table)
    return rule


def learn(table: dict[str, np.ndarray], good: np.ndarray, prune_on: np.ndarray, precision: float = 0.98, most_rules: int = 12, most_conditions: int = 4, cuts: int = 24, least: int = 3) -> list[list[Condition]]:
    """Ordered rules against a text; ``prune_on`` marks the rows kept for pruning. A rule that is not precise there is refused,
    the bad rows that it was grown from are set aside, and others are grown from the rest."""
    rules, bad = [], ~good
    left, aside = np.ones(len(good), bool), np.zeros(len(good), bool)
    while len(rules) < most_rules:
        grow = left & ~prune_on & ~aside
        if (grow & bad).sum() < least or not (grow & good).any():
            break
        rule = _grow({n: x[grow] for n, x in table.items()}, bad[grow], most_conditions, cuts)
        test, truth = {n: x[left & prune_on] for n, x in table.items()}, bad[left & prune_on]
        best = (-2.0, [])
        for k in range(len(rule), 0, -1):
            covered = _covers(rule[:k], test, len(truth))
            b, g = int((covered & truth).sum()), int((covered & ~truth).sum())
            best = max(best, ((b - g) / (b + g) if b + g else -1.0, rule[:k]), key=lambda v: v[0])
        grown = _covers(rule, table, len(good)) & grow & bad
        if not rule or not grown.any():
            break
        covered = _covers(best[1], table, len(good)) & left if best[1] else np.zeros(len(good), bool)
        b, g = int((covered & bad).sum()), int((covered & good).sum())
        if best[0] < 2 * precision - 1 or b < precision * (b + g) or b < least:
            aside |= grown
            continue
        rules.append(best[1])
        left &= ~covered
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule covers the row: an ordered CASE with one arm per rule."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit_rules(counts: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options) -> list[list[Condition]]:
    """Learn from the labelled rows outside fold 2, or from about ``sample_rows`` of them by the hash of their id if there are more."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality").dropDuplicates(["doc_id"])
    most = min(2**63 - 1, (sample_rows * 2**64) // max(usable.count(), 1) - 2**63)
    rows = counts.join(usable.where(F.xxhash64("doc_id") <= most), "doc_id").withColumns(ratio_columns()).select("doc_id", *STATISTICS, "quality", fold(F.col("doc_id")).alias("fold")).toPandas()
    rows = rows.sort_values(["doc_id", "n_words"], kind="stable")
    good = rows["quality"].to_numpy() == 1
    if good.all() or not good.any():
        return []
    return learn({n: rows[n].to_numpy(np.float64) for n in STATISTICS}, good, rows["fold"].to_numpy() == 3, **options)


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, the base counts, base_failed and kept."""
    counts = store(with_counts(docs), "counts")
    rules = fit_rules(counts, labels, sample_rows)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counts.withColumns(ratio_columns()).withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
