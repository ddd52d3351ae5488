"""Quality classifier: a sparse ensemble of rules.

Shallow trees are boosted on subsamples of the labelled statistics. Every path from a root to a node
is a conjunction of thresholds, a rule. A logistic regression with a lasso penalty over the rules
leaves few of them with a weight; the penalty is picked on rows kept aside. The rules that are left
become one Spark column expression over the statistics of a text.

Defined cases: an empty or null text has all statistics 0 and gets a score like any other; without
usable labels, or with labels of one kind only, every text gets the same score; an empty table gives
an empty result; repeated rows get the same score; other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragauge.llm import labels as L
from paragauge.llm import statistics as S

TREES, DEPTH, SUBSAMPLE, SHRINK = 40, 3, 0.5, 0.2
PENALTIES = [0.03, 0.01, 0.003, 0.001]
ACCEPT = 0.3


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[list[L.Condition], float]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * L.holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def score(self, columns: list[Column]) -> Column:
        """The probability of label 1 as a column expression over the features."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(L.as_column(rule, columns), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray]) -> list[list[L.Condition]]:
    """Paths to all nodes below the root of a regression tree."""
    paths: list[list[L.Condition]] = []
    grow: list[tuple[list[L.Condition], np.ndarray]] = [([], np.arange(len(x)))]
    while grow:
        path, rows = grow.pop()
        if len(path) == DEPTH or len(rows) < 20:
            continue
        best = (1e-9, None, None)
        y = residual[rows]
        for f, limits in enumerate(cuts):
            if not len(limits):
                continue
            place = np.searchsorted(limits, x[rows, f], "left")  # 0: at or below all limits
            n = np.cumsum(np.bincount(place, minlength=len(limits) + 1))[:-1]
            s = np.cumsum(np.bincount(place, y, minlength=len(limits) + 1))[:-1]
            fits = (n >= 10) & (len(rows) - n >= 10)
            if not fits.any():
                continue
            n, s, limits = n[fits], s[fits], limits[fits]
            total = y.sum()
            gain = s**2 / n + (total - s) ** 2 / (len(rows) - n) - total**2 / len(rows)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], f, limits[at])
        if best[1] is None:
            continue
        for above in (False, True):
            part = [*path, (best[1], above, float(best[2]))]
            paths.append(part)
            grow.append((part, rows[(x[rows, best[1]] > best[2]) == above]))
    return paths


def extract(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[list[L.Condition]]:
    """Different rules from boosted trees."""
    chance = np.random.default_rng(seed)
    cuts = [L.thresholds(x[:, f]) for f in range(x.shape[1])]
    z, rules, seen = np.zeros(len(x)), [], set()
    for _ in range(TREES):
        rows = chance.permutation(len(x))[: max(int(len(x) * SUBSAMPLE), 1)]
        residual = y - 1 / (1 + np.exp(-z))
        paths = _tree(x[rows], residual[rows], cuts)
        inner = {tuple(p[:-1]) for p in paths}
        for path in paths:
            inside = L.holds(path, x)
            mark = inside.tobytes()
            if mark not in seen and 0 < inside.sum() < len(x):
                seen.add(mark)
                rules.append(path)
            if tuple(path) not in inner and inside.any():
                z[inside] += SHRINK * 4 * residual[inside].mean()
    return rules


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 200) -> np.ndarray:
    """Weights of a logistic regression, the last one the free intercept; proximal gradient."""
    a = np.column_stack([a, np.ones(len(a))])
    w, v, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    u = np.ones(a.shape[1])
    for _ in range(20):  # largest singular value, for the step size
        u = a.T @ (a @ u)
        u /= np.linalg.norm(u) or 1
    step = 4 * len(y) / max(np.linalg.norm(a @ u) ** 2, 1e-9)
    for _ in range(steps):
        slope = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / len(y)
        new = v - step * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / faster * (new - w)
        w, t = new, faster
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ensemble:
    if len(y) == 0:
        return Ensemble(0.0, [])
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Ensemble(prior, [])
    rules = extract(x, y, seed)
    if not rules:
        return Ensemble(prior, [])
    a = np.column_stack([L.holds(r, x) for r in rules]).astype(np.float64)
    aside = np.random.default_rng(seed).random(len(y)) < 0.25

    def loss(w: np.ndarray, rows: np.ndarray) -> float:
        z = a[rows] @ w[:-1] + w[-1]
        return float(np.mean(np.logaddexp(0, z) - y[rows] * z))

    best = PENALTIES[-1]
    if aside.any() and len(set(y[~aside])) == 2:
        best = min(PENALTIES, key=lambda p: loss(lasso(a[~aside], y[~aside], p), aside))
    w = lasso(a, y, best)
    kept = [(rule, float(c)) for rule, c in zip(rules, w[:-1]) if abs(c) > 1e-6]
    return Ensemble(float(w[-1]), kept)


def train(docs: DataFrame, labels: DataFrame, **names) -> Ensemble:
    """Fitted on the bounded sample of :func:`paragauge.llm.labels.sample`."""
    return fit(*L.sample(docs, labels, **names))


def score(docs: DataFrame, model: Ensemble, key: str = "doc_id", accept: float = ACCEPT) -> DataFrame:
    """One row per input row: ``key``, held_out, score, predicted."""
    counted = S.with_counts(docs, [key])
    return (
        counted.select(key, L.held_out(F.col(key)).alias("held_out"), *S.feature_columns())
        .withColumn("score", model.score([F.col(c) for c in S.FEATURES]))
        .select(key, "held_out", "score", (F.col("score") >= accept).cast("int").alias("predicted"))
    )


def keep(docs: DataFrame, model: Ensemble, accept: float = ACCEPT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; no exchange."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        S.counts(F.col(f"`{text}`")).alias("counts"),
    )
    return rows.where(model.score(S.feature_columns("counts")) >= accept).select("row.*")
