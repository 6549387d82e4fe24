"""Quality classifier: a sparse rule ensemble over document statistics.

Shallow boosted trees propose conjunctive rules (every path of every tree); a lasso logistic regression keeps
few of them; the survivors are compiled into one Spark column expression, so scoring is a projection.
Fitting uses labelled rows only, at most about ``SAMPLE`` of them, chosen by a hash of the id.

Null and empty texts get the score of their statistics (all zero).  Without labels of both classes every
score is the share of label 1 (0.5 without labels).  Extra columns are ignored, repeated rows keep their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compovec.llm.common import documents, is_held_out, labelled, materialise, sample_by_hash
from compovec.llm.doc_stats import FEATURES, document_stats
from compovec.llm.trees import boost

#: Bound of the labelled rows that the fit sees.
SAMPLE = 20_000

Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(matrix(x, self.rules) @ self.weights + self.start)))

    def column(self) -> Column:
        """The ensemble as a column over the statistics' names."""
        total = F.lit(float(self.start))
        for rule, w in zip(self.rules, self.weights):
            test = F.lit(True)
            for j, above, t in rule:
                test = test & ((F.col(FEATURES[j]) > t) if above else (F.col(FEATURES[j]) <= t))
            total = total + F.when(test, float(w)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def simplify(rule: Rule) -> Rule:
    """Keep the tightest condition per feature and direction."""
    tight: dict[tuple[int, bool], float] = {}
    for j, above, t in rule:
        old = tight.get((j, above))
        tight[j, above] = t if old is None else max(old, t) if above else min(old, t)
    return tuple(sorted((j, above, t) for (j, above), t in tight.items()))


def matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, above, t in rule:
            out[:, k] *= (x[:, j] > t) if above else (x[:, j] <= t)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, strength: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    n, m = r.shape
    lipschitz = 0.25 * (np.linalg.norm(r, 2) ** 2 / n + 1)
    w, prior = np.zeros(m), np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = float(np.log(prior / (1 - prior)))
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(r @ zw + zb, -40, 40))) - y
        new = zw - (r.T @ e / n) / lipschitz
        new = np.sign(new) * np.maximum(np.abs(new) - strength / lipschitz, 0)
        newb = zb - e.mean() / lipschitz
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = new + (t - 1) / t2 * (new - w), newb + (t - 1) / t2 * (newb - b)
        w, b, t = new, newb, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, strength: float = 3e-4) -> Ensemble:
    if len(y) == 0 or y.min() == y.max():
        prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Ensemble([], np.zeros(0), float(np.log(prior / (1 - prior))))
    forest = boost(x, y, trees=trees, depth=depth, rate=0.2, subsample=0.6)
    seen: dict[bytes, Rule] = {}
    for rule in dict.fromkeys(simplify(p) for p in forest.paths()):
        fires = matrix(x, [rule])[:, 0] > 0
        if 0 < fires.sum() < len(y):
            seen.setdefault(np.packbits(fires).tobytes(), rule)      # rules that fire on the same rows are one
    rules = sorted(seen.values())
    w, b = lasso_logistic(matrix(x, rules), y, strength)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble([rules[k] for k in keep], w[keep], b)


def training_rows(stats: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a bounded sample; only ids and labels are joined to the (narrow) statistics."""
    rows = stats.join(sample_by_hash(labels, "doc_id", bound), "doc_id").select("doc_id", "label", *FEATURES).toPandas()
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    return rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float)


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fold."""
    stats = materialise(document_stats(documents(spark, sf_dir)), "quality-stats")
    model = fit(*training_rows(stats, labelled(spark, sf_dir, "quality", 4, 2)))
    out = stats.select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), model.column().alias("score"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


QUERIES = {"op1_rule_ensemble": op1_rule_ensemble}
