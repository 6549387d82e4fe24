"""Histogram gradient boosting of logistic loss in NumPy, with monotone constraints; trees are flat node arrays.

It fits on a bounded sample on the driver.  A tree of depth d is stored in heap order: node i has the children
2i + 1 (value at most the threshold) and 2i + 2; a node without a split repeats its value below.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray      # trees x nodes, -1 at a leaf
    threshold: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values for each row, all rows of a tree at once."""
        out = np.full(len(x), self.start)
        every = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                split = f[node]
                go = x[every, np.maximum(split, 0)] > t[node]
                node = np.where(split < 0, node, 2 * node + 1 + go)
            out += v[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -40, 40)))

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """Every path from a root to another node, as conditions (feature, above, threshold)."""
        out = []
        for f, t in zip(self.feature, self.threshold):
            stack = [(0, ())]
            while stack:
                node, path = stack.pop()
                if path:
                    out.append(path)
                if f[node] >= 0:
                    stack += [(2 * node + 1, (*path, (int(f[node]), False, float(t[node])))), (2 * node + 2, (*path, (int(f[node]), True, float(t[node]))))]
        return out


def cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate thresholds per feature: midpoints between neighbouring quantiles."""
    out = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, leaf: float = 8.0,
          penalty: float = 1.0, monotone: np.ndarray | None = None, subsample: float = 1.0, seed: int = 7) -> Forest:
    n, p = x.shape
    sign = np.zeros(p, int) if monotone is None else np.asarray(monotone, int)
    edges = cuts(x, bins)
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = max((len(e) for e in edges), default=0) + 1
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(prior / (1 - prior)))
    raw, rng, nodes = np.full(n, start), np.random.default_rng(seed), 2 ** (depth + 1) - 1
    feature, threshold, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for k in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        use = rng.random(n) < subsample if subsample < 1 else np.ones(n, bool)
        grad, hess = np.where(use, y - prob, 0.0), np.where(use, prob * (1 - prob), 0.0)
        best = lambda g, h, lo, hi: np.clip(g / (h + penalty), lo, hi)
        gain_of = lambda g, h, v: 2 * g * v - (h + penalty) * v * v
        node, low, high = np.zeros(n, np.int64), np.full(nodes, -np.inf), np.full(nodes, np.inf)
        value[k, 0] = best(grad.sum(), hess.sum(), -np.inf, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            live = (local >= 0) & (local < count)
            g, h, c = (np.zeros((count, p, width)) for _ in range(3))
            for j in range(p):
                key = local[live] * width + binned[live, j]
                for out, w in ((g, grad), (h, hess), (c, use.astype(float))):
                    out[:, j] = np.bincount(key, w[live], count * width).reshape(count, width)
            gl, hl, cl = (np.cumsum(a, axis=2)[:, :, :-1] for a in (g, h, c))
            gt, ht, ct = (a.sum(axis=2)[:, :, None] for a in (g, h, c))
            lo, hi = low[first:first + count, None, None], high[first:first + count, None, None]
            vl, vr, v0 = best(gl, hl, lo, hi), best(gt - gl, ht - hl, lo, hi), best(gt, ht, lo, hi)
            gain = gain_of(gl, hl, vl) + gain_of(gt - gl, ht - hl, vr) - gain_of(gt, ht, v0)
            allowed = (cl >= leaf) & (ct - cl >= leaf) & (sign[None, :, None] * (vr - vl) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            for i in range(count):
                flat = int(np.argmax(gain[i]))
                j, b = divmod(flat, width - 1) if width > 1 else (0, 0)
                if width == 1 or not gain[i, j, b] > 1e-6 or b >= len(edges[j]):
                    continue
                here, left, right = first + i, 2 * (first + i) + 1, 2 * (first + i) + 2
                feature[k, here], threshold[k, here] = j, edges[j][b]
                value[k, left], value[k, right] = vl[i, j, b], vr[i, j, b]
                low[[left, right]], high[[left, right]] = low[here], high[here]
                middle = (vl[i, j, b] + vr[i, j, b]) / 2
                if sign[j] > 0:
                    high[left], low[right] = middle, middle
                elif sign[j] < 0:
                    low[left], high[right] = middle, middle
                mine = node == here
                node[mine] = np.where(binned[mine, j] <= b, left, right)
        value[k] *= rate
        raw = raw + value[k, node]
    return Forest(feature, threshold, value, start, depth)
