"""Moments of vector columns: rows stay in Spark, D-by-D summaries reach the driver."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compovec.functions import arrays as A
from compovec.functions import special


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    scatter: np.ndarray          # centred sum of squares and products

    @property
    def cov(self) -> np.ndarray:
        return self.scatter / (self.n - 1)


def part_of(x: np.ndarray) -> np.ndarray:
    """Count, mean and centred products of some rows, end to end."""
    mean = x.mean(0)
    d = x - mean
    return np.concatenate([[len(x)], mean, (d.T @ d).ravel()])


def merge_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of two parts' rows together; nothing large is subtracted from anything large."""
    dim = int((-1 + np.sqrt(1 + 4 * (len(a) - 1))) / 2)
    n = a[0] + b[0]
    gap = b[1:1 + dim] - a[1:1 + dim]
    products = a[1 + dim:] + b[1 + dim:] + np.outer(gap, gap).ravel() * (a[0] * b[0] / n)
    return np.concatenate([[n], a[1:1 + dim] + gap * (b[0] / n), products])


def partial_moments(df: DataFrame, vec: str, by: list[str] = []) -> DataFrame:
    """Count, mean and centred products per group, one row per group.

    Arrow batches are reduced with matrix products inside each task, so a task
    emits one short row per group; those rows, one per task, are merged pairwise.
    """
    keys = df.select(*by).schema

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for key, g in groups:
                x = np.vstack(g[vec].to_numpy()).astype(float)
                key = key if isinstance(key, tuple) else (key,)
                part = part_of(x)
                acc[key] = merge_parts(acc[key], part) if key in acc else part
        rows = [dict(zip(by, k), _stat=v.tolist()) for k, v in acc.items()]
        yield pd.DataFrame(rows, columns=[*by, "_stat"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys.fields] + ["_stat array<double>"])
    parts = df.select(*by, vec).mapInPandas(reduce, schema)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = functools.reduce(merge_parts, (np.asarray(v, float) for v in pdf["_stat"]))
        return pdf.iloc[:1].assign(_stat=[whole.tolist()])

    return parts.groupBy(*by).applyInPandas(merge, schema)


def covariance_frame(df: DataFrame, vec: str, dim: int, by: list[str] = []) -> DataFrame:
    """Long sample covariance (by, i, j, cov), i <= j, as a DataFrame."""
    s = partial_moments(df, vec, by)
    # cells as rows over a literal index table: short generated code for any dim
    index = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(dim) for j in range(i, dim)])
    rows = s.select(*by, "_stat", F.explode(index).alias("_ij")).select(*by, "_stat", "_ij.i", "_ij.j")
    n, i, j = F.get("_stat", F.lit(0)), F.col("i"), F.col("j")
    cov = F.get("_stat", F.lit(1 + dim) + i * dim + j) / (n - 1)
    return rows.select(*by, "i", "j", cov.alias("cov"))


def collect_moments(df: DataFrame, vec: str, by: list[str] = []) -> dict[tuple, Moments]:
    """Moments per group on the driver; groups are a fixed set of settings, never data keys."""
    out = {}
    for row in partial_moments(df, vec, by).collect():
        s = np.array(row["_stat"])
        d = int((-1 + np.sqrt(1 + 4 * (len(s) - 1))) / 2)
        out[tuple(row[k] for k in by)] = Moments(int(round(s[0])), s[1:1 + d], s[1 + d:].reshape(d, d))
    return out


def moments(df: DataFrame, vec: str) -> Moments:
    return collect_moments(df, vec)[()]


@dataclass
class Basis:
    mean: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray        # one component per row
    n: int

    @property
    def ratio(self) -> np.ndarray:
        return self.eigenvalues / self.eigenvalues.sum()


def pca(m: Moments) -> Basis:
    """Principal axes, largest first, with the sign that makes the largest loading positive."""
    w, v = np.linalg.eigh(m.cov)
    order = np.argsort(w)[::-1]
    w, v = np.maximum(w[order], 0.0), v[:, order].T
    lead = np.abs(v).argmax(axis=1)
    v = v * np.sign(v[np.arange(len(v)), lead])[:, None]
    return Basis(m.mean, w, v, m.n)


def scores(df: DataFrame, basis: Basis, vec: str, k: int | None = None, name: str = "scores") -> DataFrame:
    """Centred scores on the leading ``k`` axes; narrow, loadings are literals."""
    load = basis.components if k is None else basis.components[:k]
    centred = A.subtract(F.col(vec), A.literal(basis.mean))
    return df.withColumn("_c", centred).withColumn(name, A.project(F.col("_c"), load)).drop("_c")


def score_d2(name: str, basis: Basis, start: int = 0, stop: int | None = None):
    """Squared Mahalanobis distance in a block of scores, where the covariance is diagonal."""
    lam = basis.eigenvalues[start:stop]
    block = F.slice(F.col(name), start + 1, len(lam))
    return A.total(F.zip_with(block, A.literal(1.0 / lam), lambda s, w: s * s * w))


def distance(df: DataFrame, vec: str, m: Moments, name: str = "distance") -> DataFrame:
    """Mahalanobis distance to the centroid; guarded against a singular covariance."""
    inv = inverse(m.cov)
    d = df.withColumn("_c", A.subtract(F.col(vec), A.literal(m.mean)))
    return d.withColumn(name, F.sqrt(A.quadratic_form(F.col("_c"), inv))).drop("_c")


def inverse(cov: np.ndarray) -> np.ndarray:
    """Inverse, or the pseudo-inverse where the rank is short."""
    if np.linalg.matrix_rank(cov) < cov.shape[0]:
        return np.linalg.pinv(cov)
    return np.linalg.inv(cov)


def effective_dimension(b: Basis, floor: float = 0.0) -> dict[str, float]:
    """Entropy dimension, participation ratio, count at or above the mean, share of the first three."""
    p = b.ratio
    q = p[p > 0]
    entropy = -np.sum(q * np.log(q + floor))
    lam = b.eigenvalues
    return {"entropy_dim": float(np.exp(entropy)), "participation": float(lam.sum() ** 2 / np.sum(lam ** 2)),
            "kaiser": int(np.sum(lam >= lam.mean())), "top3_share": float(p[:3].sum())}


def mardia(beta2: float, q99: float, n: int, p: int) -> dict:
    """Kurtosis z-score and tail excess from the mean fourth power and 99th percentile of distances."""
    expected = p * (p + 2)
    z = (beta2 - expected) / np.sqrt(8 * p * (p + 2) / n)
    return {"p": p, "beta2": float(beta2), "expected": float(expected), "z": float(z),
            "excess99": float(q99 / special.chi2_ppf(0.99, p)), "shape": "lepto" if z > 0 else "platy"}


def leave_one_out(df: DataFrame, vec: str, group: str, cohort: dict[tuple, Moments], in_cohort: str) -> DataFrame:
    """Distance of every row to a cohort from which the row itself was taken out.

    The cohort enters as its per-group moments.  Taking row d out of a group of
    m rows changes the pooled scatter S by the rank-one term -c d d' with
    c = m / (m - 1) and scales the deviation by c, so with q = d' S^-1 d the
    squared distance is (n - 2) c^2 q / (1 - c q): one quadratic form per row.
    Null for a row whose group is unknown, for the only row of a group, and
    where the rest of the cohort is singular.
    """
    groups = {k[0]: m for k, m in cohort.items()}
    total = sum(m.n for m in groups.values())
    inv = inverse(sum(m.scatter for m in groups.values()))
    own = lambda m: F.struct(F.lit(float(m.n)).alias("n"), A.literal(m.mean).alias("mean"))
    known = F.lit(None)
    for g, m in groups.items():
        known = F.when(F.col(group) == F.lit(g), own(m)).otherwise(known)
    d = df.withColumn("_g", known).withColumn("_d", A.subtract(F.col(vec), F.col("_g.mean")))
    d = d.withColumn("_q", A.quadratic_form(F.col("_d"), inv)).withColumn("_c", F.col("_g.n") / F.nullif(F.col("_g.n") - 1, F.lit(0.0)))
    rest = 1 - F.col("_c") * F.col("_q")
    inside = (total - 2) * F.col("_c") * F.col("_c") * F.col("_q") / F.when(rest > 0, rest)
    square = F.when(F.col(in_cohort), inside).otherwise((total - 1) * F.col("_q"))
    return d.withColumn("loo_distance", F.sqrt(square)).drop(vec, "_g", "_d", "_q", "_c")


def variance_partition(df: DataFrame, vec: str, dim: int, label: str, by: list[str] = []) -> DataFrame:
    """Total, between and within sums of squares and the between share, per ``by`` group."""
    sums = [F.sum(F.get(F.col(vec), F.lit(i))) for i in range(dim)]
    g = df.groupBy(*by, label).agg(F.count("*").alias("n"), F.array(*sums).alias("s"), F.sum(A.dot(F.col(vec), F.col(vec))).alias("q"))
    between = A.dot(F.col("s"), F.col("s")) / F.col("n")
    t = g.groupBy(*by).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dim)]).alias("s"),
                           F.sum("q").alias("q"), F.sum(between).alias("_between"))
    centre = A.dot(F.col("s"), F.col("s")) / F.col("n")
    t = t.select(*by, "n", (F.col("q") - centre).alias("total"), (F.col("_between") - centre).alias("between"))
    return t.withColumn("within", F.col("total") - F.col("between")).withColumn("eta2", F.col("between") / F.nullif(F.col("total"), F.lit(0.0)))
