"""Quality rules: an ordered decision list learned by sequential covering.

Rules for bad texts are grown condition by condition on two thirds of the labelled rows, by the gain
in information about the rows they still cover, then pruned from the end on the other third. A rule
that is precise enough on that third is kept, the rows it covers go, and the next rule is grown on
the rest. The list becomes one ordered conditional expression; texts that no rule covers are kept.

Defined cases: an empty or null text fails the base rule; without usable labels the list is empty
and only the base rule decides; an empty table gives an empty result; repeated rows are judged
alike; other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragauge.llm import labels as L
from paragauge.llm import statistics as S

PRECISION = 0.9
LEAST_COVERED = 4
LEAST_WORDS = 10
REPEAT_PERCENT = 20


@dataclass
class DecisionList:
    """Rules for bad texts, in order; the first that holds decides."""

    rules: list[list[L.Condition]]

    def reject(self, x: np.ndarray) -> np.ndarray:
        found = np.zeros(len(x), bool)
        for rule in self.rules:
            found |= L.holds(rule, x)
        return found

    def number(self, columns: list[Column]) -> Column:
        """The number of the rule that decides, from 1; null if none holds."""
        found = None
        for i, rule in enumerate(self.rules, 1):
            condition, value = L.as_column(rule, columns), F.lit(i)
            found = F.when(condition, value) if found is None else found.when(condition, value)
        return F.lit(None).cast("int") if found is None else found

    def wording(self) -> list[str]:
        return [L.wording(rule) for rule in self.rules]


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray]) -> list[L.Condition]:
    rule: list[L.Condition] = []
    rows = np.arange(len(x))
    while True:
        p, n = bad[rows].sum(), (~bad[rows]).sum()
        if p == 0 or n == 0:
            return rule
        now, best = np.log2(p / (p + n)), (1e-9, None)
        for f, limits in enumerate(cuts):
            if not len(limits):
                continue
            place = np.searchsorted(limits, x[rows, f], "left")
            size = len(limits) + 1
            below_p = np.cumsum(np.bincount(place[bad[rows]], minlength=size))[:-1]
            below_n = np.cumsum(np.bincount(place[~bad[rows]], minlength=size))[:-1]
            for above, a, b in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1) / np.maximum(a + b, 1)) - now), 0)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], (f, above, float(limits[at])))
        if best[1] is None:
            return rule
        rule.append(best[1])
        rows = rows[L.holds([best[1]], x[rows])]


def _prune(rule: list[L.Condition], x: np.ndarray, bad: np.ndarray) -> list[L.Condition]:
    """The beginning of the rule with the best balance of bad and good rows it covers."""

    def worth(n: int) -> float:
        inside = L.holds(rule[:n], x)
        p, q = (bad & inside).sum(), (~bad & inside).sum()
        return (p - q) / (p + q) if p + q else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> DecisionList:
    """Learns rules for label 0."""
    bad = y == 0
    if not len(y) or not bad.any() or bad.all():
        return DecisionList([])
    cuts = [L.thresholds(x[:, f], 64) for f in range(x.shape[1])]
    chance = np.random.default_rng(seed)
    left, rules = np.ones(len(y), bool), []
    while True:
        growing = chance.random(len(y)) < 2 / 3
        grow, prune = left & growing, left & ~growing
        if (bad & grow).sum() < LEAST_COVERED or (bad & prune).sum() < 1:
            return DecisionList(rules)
        rule = _grow(x[grow], bad[grow], cuts)
        if not rule:
            return DecisionList(rules)
        rule = _prune(rule, x[prune], bad[prune])
        inside = L.holds(rule, x)
        checked = inside & prune
        precise = (bad & checked).sum() >= PRECISION * max(checked.sum(), 1)
        if not precise or (bad & inside & left).sum() < LEAST_COVERED:
            return DecisionList(rules)
        rules.append(rule)
        left &= ~inside


def train(docs: DataFrame, labels: DataFrame, **names) -> DecisionList:
    """Fitted on the bounded sample of :func:`paragauge.llm.labels.sample`."""
    return fit(*L.sample(docs, labels, **names))


def judge(docs: DataFrame, rules: DecisionList, key: str = "doc_id") -> DataFrame:
    """One row per input row: ``key``, five counts, base_failed, rule (its number), kept."""
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    rule = rules.number(S.feature_columns())
    return (
        S.with_counts(docs, [key])
        .select(key, *base, failed.alias("base_failed"), rule.alias("rule"))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
