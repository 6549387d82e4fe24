"""Thousands of weighted Gaussian mixtures in shared passes: bootstrap stability of a clustering.

A row's log density under all components of all models is one matrix product: with the features ``(1, x, x x')`` a component is
a column of coefficients.  The sums of the next step are another product of the same features with the posteriors.  So
a pass serves every draw, every number of components and every start at once, in tiles of models and rows, and
a task returns a few numbers per component whatever its rows.  Weights of a draw are Poisson(1), made inside the task from one hash
per (row, draw) and never stored.

The driver holds the models (draws x numbers of components x starts, a parameter of the call), never rows.  Rows are
centred and whitened by the moments of all rows first, so the products do not cancel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compovec.operators.mixture import null_rand_indices, rand_from_table

#: Models of one tile, and numbers that a tile of rows and models may take: its arrays are to stay in a core's cache.
TILE_MODELS, TILE_CELLS = 512, 1 << 17
#: Numbers that a block of rows and all runs may take while starts are drawn.
RUN_CELLS = 1 << 21
#: Cumulated Poisson(1) probabilities; the rest of the tail is below the spacing of the uniforms.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)])))


def mixed(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Uniforms in (0, 1) for every row hash and every salt, shape (rows, salts)."""
    z = h[:, None] ^ (salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def poisson(h: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Multiplicity of every row in every draw; draw -1 takes each row once."""
    out = np.searchsorted(_POISSON, mixed(h, draws + 1), side="right").astype(float)
    out[:, draws < 0] = 1.0
    return out


def features(x: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


@dataclass
class Family:
    """Models of one number of components: weights (m, k), means (m, k, p), covariances (m, k, p, p)."""

    k: int
    draw: np.ndarray
    seed: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    loglik: np.ndarray
    n: np.ndarray
    done: np.ndarray

    def take(self, at: np.ndarray) -> Family:
        return Family(self.k, *(getattr(self, f)[at] for f in ("draw", "seed", "weights", "means", "covs", "loglik", "n", "done")))

    def coefficients(self) -> np.ndarray:
        """Columns that turn features into log densities, shape (features, m * k)."""
        p = self.means.shape[2]
        inverse, (sign, logdet) = np.linalg.inv(self.covs), np.linalg.slogdet(self.covs)
        i, j = np.triu_indices(p)
        quadratic = -inverse[:, :, i, j] * np.where(i == j, 0.5, 1.0)
        linear = np.einsum("mkij,mkj->mki", inverse, self.means)
        with np.errstate(divide="ignore"):
            constant = np.log(self.weights) - 0.5 * (p * np.log(2 * np.pi) + logdet + np.einsum("mki,mki->mk", linear, self.means))
        return np.concatenate([constant[:, :, None], linear, quadratic], axis=2).reshape(len(self.draw) * self.k, -1).T.copy()

    def nearest(self) -> np.ndarray:
        """Columns that turn features into minus half the squared distance to each centre, but for a term of the row."""
        p = self.means.shape[2]
        out = np.concatenate([-0.5 * (self.means**2).sum(2)[:, :, None], self.means, np.zeros((*self.means.shape[:2], p * (p + 1) // 2))], axis=2)
        return out.reshape(len(self.draw) * self.k, -1).T.copy()

    def update(self, sums: np.ndarray, ridge: float) -> None:
        """Parameters from the features' sums, shape (m, k, features)."""
        p = self.means.shape[2]
        nk = sums[:, :, 0] + 1e-10
        self.weights = nk / nk.sum(1, keepdims=True)
        self.means = sums[:, :, 1:1 + p] / nk[:, :, None]
        i, j = np.triu_indices(p)
        second = np.zeros((*nk.shape, p, p))
        second[:, :, i, j] = sums[:, :, 1 + p:] / nk[:, :, None]
        second[:, :, j, i] = second[:, :, i, j]
        covs = second - self.means[:, :, :, None] * self.means[:, :, None, :] + ridge * np.eye(p)
        few = nk <= p + 1                                  # too few rows for a spread of their own: that of all rows
        covs[few] = np.eye(p)
        self.covs = covs


def _tiles(families: list[Family], columns: str) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(tile, k, draws, coefficients) of all models, ``TILE_MODELS`` at a time; models lie side by side for each component."""
    out = []
    for f in families:
        c = getattr(f, columns)()
        for a in range(0, len(f.draw), TILE_MODELS):
            some = c[:, a * f.k:(a + TILE_MODELS) * f.k]
            out.append((len(out), f.k, f.draw[a:a + TILE_MODELS], np.ascontiguousarray(some.reshape(len(c), -1, f.k).transpose(0, 2, 1)).reshape(len(c), -1)))
    return out


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    p = len(b.column("x")[0])
    return b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the tasks' numbers of one tile."""
    total = None
    for b in batches:
        for raw in b.column("sums").to_pylist():
            part = np.frombuffer(raw)
            total = part.copy() if total is None else total + part
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["tile", "sums"])


def tile_sums(df: DataFrame, work, shapes: list[int]) -> list[np.ndarray]:
    """Add up over all rows what ``work(h, x, out)`` adds to the arrays ``out`` (one per tile, of these lengths), batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some = [np.zeros(n) for n in shapes], False
        for b in batches:
            if b.num_rows:
                some = True
                work(*_rows(b), out)
        if some:
            for i, v in enumerate(out):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["tile", "sums"])

    parts = df.mapInArrow(run, "tile long, sums binary").groupBy("tile").applyInArrow(add_up, "tile long, sums binary")
    out = [np.zeros(n) for n in shapes]
    for r in parts.collect():                               # one row per tile
        out[r["tile"]] = np.frombuffer(r["sums"])
    return out


def posterior_sums(df: DataFrame, families: list[Family], hard: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One pass over all rows: per family the features' sums by component, the log likelihoods and the weights' sums."""
    tiles = _tiles(families, "nearest" if hard else "coefficients")
    shared = df.sparkSession.sparkContext.broadcast(tiles)
    size = len(tiles[0][3])

    def work(h: np.ndarray, x: np.ndarray, out: list[np.ndarray]) -> None:
        f = features(x)
        for i, k, draws, theta in shared.value:
            step, m = max(1, TILE_CELLS // theta.shape[1]), len(draws)
            each, of = np.unique(draws, return_inverse=True)
            for a in range(0, len(x), step):
                some = f[a:a + step]
                logp = (some @ theta).reshape(len(some), k, m)
                w = poisson(h[a:a + step], each)[:, of]
                top = logp.max(1)
                if hard:
                    best = logp.argmax(1)
                    post, gain = np.where(best[:, None, :] == np.arange(k)[None, :, None], w[:, None, :], 0.0), top
                else:
                    post = np.exp(np.subtract(logp, top[:, None, :], out=logp), out=logp)
                    total = post.sum(1)
                    gain = top + np.log(total)
                    post *= (w / total)[:, None, :]
                out[i][:2 * m] += np.concatenate([(w * gain).sum(0), w.sum(0)])
                out[i][2 * m:] += (some.T @ post.reshape(len(some), k * m)).ravel()

    flat = tile_sums(df, work, [2 * len(d) + size * t.shape[1] for _, _, d, t in tiles])
    shared.unpersist()
    out, at = [], 0
    for f in families:
        parts = []
        while at < len(tiles) and tiles[at][1] == f.k and sum(len(p[1]) for p in parts) < len(f.draw):
            m = len(tiles[at][2])
            parts.append((flat[at][2 * m:].reshape(size, f.k, m).transpose(2, 1, 0), flat[at][:m], flat[at][m:2 * m]))
            at += 1
        out.append(tuple(np.concatenate([p[i] for p in parts]) for i in range(3)))
    return out


def start_centres(df: DataFrame, runs: np.ndarray, length: int, dim: int) -> np.ndarray:
    """Centres (runs, length, dim) of every (seed, draw), each drawn from all rows in proportion to weight and squared distance.

    A row waits an exponential time with that rate, and the first one is drawn.  A pass adds one centre to every run.
    """
    centres = np.zeros((len(runs), 0, dim))
    for turn in range(length):
        shared = df.sparkSession.sparkContext.broadcast(centres)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, value = np.full(len(runs), np.inf), np.zeros((len(runs), dim))
            salt = (runs[:, 0] + 1) * 1_000_003 + (runs[:, 1] + 2) * 7_919 + turn + (1 << 40)
            each, of = np.unique(runs[:, 1], return_inverse=True)
            for b in batches:
                if not b.num_rows:
                    continue
                h, x = _rows(b)
                step = max(1, RUN_CELLS // len(runs))
                for a in range(0, len(x), step):
                    hh, xx = h[a:a + step], x[a:a + step]
                    rate = poisson(hh, each)[:, of]
                    if turn:
                        near = np.full((len(xx), len(runs)), np.inf)
                        for c in range(turn):
                            own = shared.value[:, c]
                            near = np.minimum(near, (xx**2).sum(1)[:, None] - 2 * xx @ own.T + (own**2).sum(1)[None, :])
                        rate *= np.maximum(near, 0.0)
                    with np.errstate(divide="ignore"):
                        wait = -np.log(mixed(hh, salt)) / rate
                    at = wait.argmin(0)
                    least = wait[at, np.arange(len(runs))]
                    better = least < best
                    best[better], value[better] = least[better], xx[at[better]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(runs))), pa.array(best), pa.array(list(value), pa.list_(pa.float64()))], names=["run", "wait", "x"])

        found = df.mapInArrow(first, "run long, wait double, x array<double>").groupBy("run").agg(F.min_by("x", F.struct("wait", "x")).alias("x")).toPandas()
        new = np.zeros((len(runs), 1, dim))
        new[found["run"].to_numpy(), 0] = np.vstack(found["x"].to_numpy())
        centres = np.concatenate([centres, new], axis=1)
        shared.unpersist()
    return centres


def whitened(df: DataFrame, vec: str, key: list[str], mean: np.ndarray, cov: np.ndarray) -> DataFrame:
    """Rows (h, x): a hash of the key and the vector in whitened coordinates."""
    turn = np.linalg.inv(np.linalg.cholesky(cov)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)) if b.num_rows else np.zeros((0, len(mean)))
            y = (x - mean) @ turn
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(list(y), pa.list_(pa.float64()))], names=["h", "x"])

    return df.select(F.xxhash64(*key).alias("h"), F.col(vec).alias("x")).mapInArrow(run, "h long, x array<double>")


def fit_families(rows: DataFrame, dim: int, ks: list[int], draws: list[int], starts: int, lloyd: int = 3, max_iter: int = 500, tol: float = 1e-3,
                 ridge: float = 1e-6) -> list[Family]:
    """Every (k, draw, start) by EM on whitened ``rows`` (h, x); models that have converged leave the passes."""
    runs = np.array([(s, b) for b in draws for s in range(starts)])
    centres = start_centres(rows, runs, max(ks), dim)
    families = []
    for k in ks:
        m = len(runs)
        families.append(Family(k, runs[:, 1].copy(), runs[:, 0].copy(), np.full((m, k), 1 / k), centres[:, :k].copy(), np.tile(np.eye(dim), (m, k, 1, 1)),
                               np.full(m, -np.inf), np.zeros(m), np.zeros(m, bool)))
    for _ in range(lloyd + 1):
        for f, (sums, _, _) in zip(families, posterior_sums(rows, families, hard=True)):
            empty = sums[:, :, 0] <= 0
            kept = f.means.copy()
            f.update(sums, ridge)
            f.means[empty] = kept[empty]
    for turn in range(max_iter):
        live = [(f, np.flatnonzero(~f.done)) for f in families]
        live = [(f, at, f.take(at)) for f, at in live if len(at)]
        if not live:
            break
        for (f, at, part), (sums, loglik, n) in zip(live, posterior_sums(rows, [p for _, _, p in live])):
            with np.errstate(invalid="ignore", divide="ignore"):
                done = np.abs(loglik - part.loglik) <= tol * n
            part.update(sums, ridge)
            f.loglik[at], f.n[at], f.done[at] = loglik, n, done
            go = at[~done]
            f.weights[go], f.means[go], f.covs[go] = part.weights[~done], part.means[~done], part.covs[~done]
    return families


def best_starts(f: Family) -> Family:
    """The start with the highest likelihood of every draw, in the order of the draws."""
    order = np.lexsort((f.seed, -f.loglik, f.draw))
    return f.take(order[np.unique(f.draw[order], return_index=True)[1]])


def tables_against(rows: DataFrame, families: list[Family]) -> list[np.ndarray]:
    """Contingency tables (models, k, k) of each family's first model with all of its models, on all rows once."""
    shared = rows.sparkSession.sparkContext.broadcast([(f.k, f.coefficients()) for f in families])

    def work(h: np.ndarray, x: np.ndarray, out: list[np.ndarray]) -> None:
        f = features(x)
        for i, (k, theta) in enumerate(shared.value):
            step = max(1, TILE_CELLS // theta.shape[1])
            for a in range(0, len(x), step):
                label = (f[a:a + step] @ theta).reshape(-1, theta.shape[1] // k, k).argmax(2)
                hot = np.zeros((len(label), k))
                hot[np.arange(len(label)), label[:, 0]] = 1
                each = np.zeros((*label.shape, k))
                np.put_along_axis(each, label[:, :, None], 1.0, axis=2)
                out[i] += (hot.T @ each.reshape(len(label), -1)).reshape(k, -1, k).transpose(1, 0, 2).ravel()

    flat = tile_sums(rows, work, [len(f.draw) * f.k * f.k for f in families])
    shared.unpersist()
    return [v.reshape(-1, f.k, f.k) for v, f in zip(flat, families)]


def stability(df: DataFrame, vec: str, key: list[str], mean: np.ndarray, cov: np.ndarray, ks: list[int], n_boot: int = 1_000, n_null: int = 10_000, starts: int = 10,
              seed: int = 42) -> pd.DataFrame:
    """Agreement of refits on bootstrap draws with the fit on all rows, against shuffled labels, for each number of components.

    Expects a row per unit with a full-rank covariance.  The null law is drawn from the exact law of the tables of shuffles.
    """
    # short rows that many passes read: all cores share them
    rows = whitened(df, vec, key, mean, cov).repartition(df.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        best = [best_starts(f) for f in fit_families(rows, len(mean), ks, list(range(-1, n_boot)), starts)]
        tables = tables_against(rows, best)
    finally:
        rows.unpersist()
    out = []
    for f, t in zip(best, tables):
        boot = np.array([rand_from_table(x) for x in t[1:]])
        null = null_rand_indices(t[0].sum(1), n_null, seed)
        above = int((null >= boot.mean()).sum())
        spread = np.sqrt((boot.var(ddof=1) + null.var(ddof=1)) / 2)
        figures = {f"{n}_{c}": float(v) for n, a in (("boot", boot), ("null", null)) for c, v in
                   (("mean", a.mean()), ("sd", a.std(ddof=1)), ("median", np.median(a)), ("lo", np.percentile(a, 2.5)), ("hi", np.percentile(a, 97.5)),
                    ("least", a.min()), ("most", a.max()))}
        out.append(dict(k=f.k, draws=len(boot), nulls=len(null), **figures, effect=float((boot.mean() - null.mean()) / spread), null_ge=above,
                        p=(above + 1) / (n_null + 1), floor=1 / (n_null + 1), converged=float(f.done.mean())))
    return pd.DataFrame(out)
