"""Gaussian mixtures and the multivariate t by EM over distributed moment sums.

Every iteration is one pass over a cached frame that serves all models at once
(numbers of components, restarts, bootstrap draws): tasks reduce Arrow batches
to weighted sums with NumPy, Spark adds the sums, and the driver updates a few
small matrices.  No task ever holds more than its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compovec.functions import special
from compovec.operators import resample


@dataclass
class Mixture:
    k: int
    seed: int
    draw: int
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    loglik: float = -np.inf
    n: float = 0.0
    done: bool = False
    trail: list = field(default_factory=list)

    @property
    def converged(self) -> bool:
        """Whether the last pass gained less than the tolerance; the likelihood is that of the parameters either way."""
        return self.done

    @property
    def bic(self) -> float:
        p = self.means.shape[1]
        params = self.k * p * (p + 1) / 2 + self.k * p + self.k - 1
        return -2 * self.loglik + params * np.log(self.n)

    def _by_component(self, x: np.ndarray) -> np.ndarray:
        """Log density of every component, a row each: one product turns the rows by all inverse factors at once."""
        p = x.shape[1]
        low = np.linalg.cholesky(self.covs)
        turn = np.linalg.inv(low)
        y = turn.transpose(1, 0, 2).reshape(p * self.k, p) @ x.T
        y -= np.einsum("cij,cj->ic", turn, self.means).reshape(p * self.k, 1)
        y *= y
        const = np.log(self.weights) - 0.5 * p * np.log(2 * np.pi) - np.log(np.einsum("cii->ci", low)).sum(1)
        return const[:, None] - 0.5 * y.reshape(p, self.k, len(x)).sum(0)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return self._by_component(x).T

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self._by_component(x)
        top = e.max(0)
        e = np.exp(np.subtract(e, top, out=e), out=e)
        s = e.sum(0)
        e /= s
        return e.T, top + np.log(s)


def add_stats(df: DataFrame, fn, cols: list[str]) -> np.ndarray:
    """Sum over all rows of a vector computed per Arrow batch; one row per task travels."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for pdf in batches:
            if len(pdf):
                part = fn(pdf)
                acc = part if acc is None else acc + part
        if acc is not None:
            yield pd.DataFrame({"s": [acc.tolist()]})

    parts = df.select(*cols).mapInPandas(run, "s array<double>")
    return np.array(parts.agg(vector_to_array(Summarizer.sum(array_to_vector("s")))).first()[0])


def bootstrap_weights(df: DataFrame, key: list[str], n_draws: int) -> DataFrame:
    """Add ``boot``: Poisson(1) multiplicities of the row in every draw, from hashes; narrow."""
    cdf, acc, term = [], 0.0, float(np.exp(-1))
    for i in range(12):
        acc += term
        cdf.append(acc)
        term /= i + 1

    def times(b: Column) -> Column:
        h = resample.hash_key(b, *key)
        u = F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
        limits = F.array(*[F.lit(c) for c in cdf])
        return F.size(F.filter(limits, lambda c: u >= c)).cast("double")

    return df.withColumn("boot", F.transform(F.sequence(F.lit(0), F.lit(n_draws - 1)), times))


def _uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers between 0 and 1 from row hashes, others for every salt."""
    step = 0
    for s in salt:
        step = (step * 1_000_003 + s + 2) * 0x9E3779B97F4A7C15 % 2**64
    z = h ^ np.uint64(step)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def _weights(pdf: pd.DataFrame, draw: int) -> np.ndarray:
    return np.ones(len(pdf)) if draw < 0 else np.array([b[draw] for b in pdf["boot"]], float)


def _centres(df: DataFrame, vec: str, key: list[str], runs: list[tuple[int, int]], length: int, shift: np.ndarray, cols: list[str]) -> dict:
    """Starting centres of every (seed, draw): each is drawn from all rows, in proportion to the squared distance to those before it.

    A row waits an exponential time with that rate and the first one is drawn; a
    pass adds one centre to every run, and a task sends one row per run.
    """
    centres: dict = {r: np.empty((0, len(shift))) for r in runs}
    for turn in range(length):
        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple[float, np.ndarray]] = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.vstack(pdf[vec].to_numpy()).astype(float) - shift
                h = pd.util.hash_pandas_object(pdf[key], index=False).to_numpy(np.uint64)
                for i, r in enumerate(runs):
                    rate = _weights(pdf, r[1])
                    if turn:
                        rate = rate * np.min([((x - c) ** 2).sum(1) for c in centres[r]], axis=0)
                    with np.errstate(divide="ignore"):
                        wait = -np.log(_uniform(h, *r, turn)) / rate
                    at = int(wait.argmin())
                    if i not in best or wait[at] < best[i][0]:
                        best[i] = float(wait[at]), x[at]
            yield pd.DataFrame([(i, w, v.tolist()) for i, (w, v) in best.items()], columns=["run", "wait", "x"])

        found = df.select(*key, *cols).mapInPandas(first, "run int, wait double, x array<double>")
        rows = found.groupBy("run").agg(F.min_by("x", F.struct("wait", "x")).alias("x")).collect()
        centres = {runs[r["run"]]: np.vstack([centres[runs[r["run"]]], r["x"]]) for r in rows}
    return centres


def _start(df: DataFrame, vec: str, key: list[str], specs: list[tuple[int, int, int]], shift: np.ndarray, cols: list[str], ridge: float,
           steps: int = 10) -> list[Mixture]:
    """Models around spread-out centres after a few Lloyd steps over all rows, all models in each pass."""
    runs = sorted({(s, b) for _, s, b in specs})
    centres = _centres(df, vec, key, runs, max(k for k, _, _ in specs), shift, cols)
    means, p = [centres[s, b][:k].copy() for k, s, b in specs], len(shift)
    for step in range(steps + 1):
        def sums(pdf: pd.DataFrame) -> np.ndarray:
            x = np.vstack(pdf[vec].to_numpy()).astype(float) - shift
            out = [(x.T @ x).ravel()]
            for (k, _, b), c in zip(specs, means):
                far = sum((xj - cj[:, None]) ** 2 for xj, cj in zip(x.T, c.T))      # centres by rows
                own = far.argmin(0)
                d, hot = x - c[own], np.zeros((len(x), k))
                hot[np.arange(len(x)), own] = _weights(pdf, b)
                out += [hot.sum(0), (hot.T @ d).ravel()]
                if step == steps:
                    out.append((hot.T @ (d[:, :, None] * d[:, None, :]).reshape(len(x), -1)).ravel())
            return np.concatenate(out)

        flat, at, models = add_stats(df, sums, cols), p * p, []
        for i, (k, s, b) in enumerate(specs):
            n, d = flat[at:at + k], flat[at + k:at + k + k * p].reshape(k, p)
            at += k + k * p
            d = d / np.maximum(n, 1e-300)[:, None]
            if step == steps:
                total = n.sum()
                pooled = flat[:p * p].reshape(p, p) / total
                covs = flat[at:at + k * p * p].reshape(k, p, p) / np.maximum(n, 1.0)[:, None, None] - d[:, :, None] * d[:, None, :]
                at += k * p * p
                covs[n <= p + 1] = pooled          # too few rows for a spread of their own
                models.append(Mixture(k, s, b, np.maximum(n, 1.0) / np.maximum(n, 1.0).sum(), means[i] + d, covs + ridge * np.eye(p)))
            means[i] = means[i] + d
    return models


def fit(df: DataFrame, vec: str, key: list[str], specs: list[tuple[int, int, int]], max_iter: int = 100,
        tol: float = 1e-3, ridge: float = 1e-6) -> list[Mixture]:
    """Fit every ``(k, seed, draw)``; draw -1 means all rows once, else the row's ``boot`` weight.

    ``df`` should be cached.  Models that have converged drop out of the pass; one
    that is still moving after ``max_iter`` passes says so in ``converged``.  All sums
    are taken around the mean of all rows, so large means do not cancel.
    """
    weighted = any(b >= 0 for _, _, b in specs)
    cols = [vec, "boot"] if weighted else [vec]
    shift = add_stats(df, lambda pdf: np.append(np.vstack(pdf[vec].to_numpy()).astype(float).sum(0), len(pdf)), [vec])
    shift = shift[:-1] / shift[-1]
    models, p = _start(df, vec, key, specs, shift, cols, ridge), len(shift)
    for turn in range(max_iter):
        live = [m for m in models if not m.done]
        if not live:
            break

        def sums(pdf: pd.DataFrame) -> np.ndarray:
            x = np.vstack(pdf[vec].to_numpy()).astype(float) - shift
            boot = np.vstack(pdf["boot"].to_numpy()) if weighted else None
            xx = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            out = []
            for m in live:
                r, ll = m.posterior(x)
                w = boot[:, m.draw] if m.draw >= 0 else np.ones(len(x))
                rw = r * w[:, None]
                out += [[w.sum(), (ll * w).sum()], rw.sum(0), (rw.T @ x).ravel(), (rw.T @ xx).ravel()]
            return np.concatenate([np.ravel(o) for o in out])

        flat, at = add_stats(df, sums, cols), 0
        for m in live:
            n, ll = flat[at:at + 2]
            at += 2
            nk = flat[at:at + m.k] + 1e-10
            at += m.k
            s1 = flat[at:at + m.k * p].reshape(m.k, p)
            at += m.k * p
            s2 = flat[at:at + m.k * p * p].reshape(m.k, p, p)
            at += m.k * p * p
            m.done = m.n > 0 and abs(ll - m.loglik) / n < tol
            m.loglik, m.n = float(ll), float(n)
            m.trail.append(m.loglik)
            if m.done or turn == max_iter - 1:
                continue
            m.weights, m.means = nk / nk.sum(), s1 / nk[:, None]
            m.covs = s2 / nk[:, None, None] - m.means[:, :, None] * m.means[:, None, :] + ridge * np.eye(p)
    for m in models:
        m.means = m.means + shift
    return models


def best_by_k(models: list[Mixture]) -> dict[int, Mixture]:
    """The restart with the highest likelihood for every number of components."""
    out: dict[int, Mixture] = {}
    for m in models:
        if m.k not in out or m.loglik > out[m.k].loglik:
            out[m.k] = m
    return out


def assign(df: DataFrame, vec: str, model: Mixture, label: str = "mode", post: str = "posterior_max") -> DataFrame:
    """Add the most likely component and its posterior."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for pdf in batches:
            x = np.vstack(pdf[vec].to_numpy()).astype(float) if len(pdf) else np.empty((0, model.means.shape[1]))
            r, _ = model.posterior(x)
            yield pdf.assign(**{label: r.argmax(1).astype("int32"), post: r.max(1)})

    return df.mapInPandas(run, f"{fields}, {label} int, {post} double")


def rand_indices(df: DataFrame, vec: str, models: list[Mixture], pairs: list[tuple[int, int]] | None = None) -> list[float]:
    """Adjusted Rand index of model pairs on all rows, from contingency tables added across tasks."""
    pairs = list(combinations(range(len(models)), 2)) if pairs is None else pairs

    def tables(pdf: pd.DataFrame) -> np.ndarray:
        x = np.vstack(pdf[vec].to_numpy()).astype(float)
        labels = [m.log_density(x).argmax(1) for m in models]
        return np.concatenate([np.bincount(labels[a] * models[b].k + labels[b], minlength=models[a].k * models[b].k)
                               for a, b in pairs]).astype(float)

    flat, at, out = add_stats(df, tables, [vec]), 0, []
    for a, b in pairs:
        size = models[a].k * models[b].k
        out.append(rand_from_table(flat[at:at + size].reshape(models[a].k, models[b].k)))
        at += size
    return out


def rand_from_table(t: np.ndarray) -> float:
    c2 = lambda v: (v * (v - 1) / 2).sum()
    n = t.sum()
    index, sa, sb = c2(t), c2(t.sum(1)), c2(t.sum(0))
    expected, top = sa * sb / (n * (n - 1) / 2), (sa + sb) / 2
    return 1.0 if top == expected else float((index - expected) / (top - expected))


def null_rand_indices(sizes: np.ndarray, n_perm: int, seed: int = 42) -> np.ndarray:
    """Permutation null of the index between a labeling and its shuffles.

    A shuffle only enters through its contingency table, whose law given the
    group sizes is multivariate hypergeometric: drawing the table directly is
    exact and needs no pass over rows.
    """
    rng = np.random.default_rng(seed)
    out = np.empty(n_perm)
    for i in range(n_perm):
        left, rows = sizes.astype(np.int64).copy(), []
        for s in sizes[:-1].astype(np.int64):
            r = rng.multivariate_hypergeometric(left, s)
            rows.append(r)
            left = left - r
        rows.append(left)
        out[i] = rand_from_table(np.array(rows, float))
    return out


@dataclass
class StudentT:
    nu: float
    mean: np.ndarray
    scale: np.ndarray
    loglik: float
    n: int
    iterations: int

    @property
    def bic(self) -> float:
        p = len(self.mean)
        return -2 * self.loglik + (p + p * (p + 1) // 2 + 1) * np.log(self.n)


def _cholesky(cov: np.ndarray) -> np.ndarray:
    """Lower factor of a scatter; a near-singular one gets a ridge relative to its own size."""
    size = max(float(np.trace(cov)) / len(cov), np.finfo(float).tiny)
    for ridge in (0.0, 1e-12, 1e-10, 1e-8, 1e-6):
        try:
            return np.linalg.cholesky(cov + ridge * size * np.eye(len(cov)))
        except np.linalg.LinAlgError:
            continue
    raise ValueError("the scatter is not positive definite")


def _degrees_of_freedom(gap: float, least: float = 0.1, most: float = 500.0) -> float:
    """The v with log(v/2) - digamma(v/2) = ``gap``.

    The left side falls from infinity to 0 like 1/(2x) + 1/(12x^2) with x = v/2: that series gives the start,
    its slope the steps.
    """
    if gap <= 0:
        return most
    x = (6 + np.sqrt(36 + 48 * gap)) / (24 * gap)
    for _ in range(20):
        step = (np.log(x) - special.digamma(x) - gap) / (1 / (2 * x**2) + 1 / (6 * x**3))
        x = max(x + step, x / 4)
        if abs(step) < 1e-10 * x:
            break
    return float(np.clip(2 * x, least, most))


def fit_t(df: DataFrame, vec: str, start_mean: np.ndarray, start_cov: np.ndarray, scale: str = "n", nu: float = 5.0,
          max_iter: int = 300, tol: float = 1e-6) -> StudentT:
    """Multivariate t by EM; ``scale`` divides the scatter by n or by the weight sum.

    A pass over the data returns weighted sums of whitened residuals from the current mean, so no large numbers
    cancel; mean and scatter then move by what the residuals say.  It ends when a pass gains less than ``tol``.
    """
    if scale not in ("n", "w"):
        raise ValueError("scale must be 'n' or 'w'")
    mean, factor, p = np.array(start_mean, float), _cholesky(np.array(start_cov, float)), len(start_mean)
    last, ll, n = None, -np.inf, 0
    for it in range(1, max_iter + 1):
        whiten = np.linalg.inv(factor)

        def sums(pdf: pd.DataFrame) -> np.ndarray:
            z = (np.vstack(pdf[vec].to_numpy()).astype(float) - mean) @ whiten.T
            far = np.einsum("ij,ij->i", z, z)
            w = (nu + p) / (nu + far)
            return np.concatenate([[len(z), w.sum(), np.log(w).sum(), np.log1p(far / nu).sum()], w @ z, ((z * w[:, None]).T @ z).ravel()])

        s = add_stats(df, sums, [vec])
        n, total, logs, tail = s[:4]
        first, second = s[4:4 + p] / s[1], s[4 + p:].reshape(p, p)
        constant = special.lgamma((nu + p) / 2) - special.lgamma(nu / 2) - p / 2 * np.log(nu * np.pi) - np.log(np.diag(factor)).sum()
        ll = n * constant - (nu + p) / 2 * tail
        if last is not None and abs(ll - last) < tol:
            break
        last = ll
        # expected log weight minus expected weight, at the weights' own degrees of freedom
        half = (nu + p) / 2
        gap = total / n - logs / n - 1 - special.digamma(half) + np.log(half)
        inner = (second - total * np.outer(first, first)) / (n if scale == "n" else total)
        mean = mean + factor @ first
        factor = _cholesky(factor @ ((inner + inner.T) / 2) @ factor.T)
        nu = _degrees_of_freedom(gap)
    return StudentT(nu, mean, factor @ factor.T, float(ll), int(n), it)
