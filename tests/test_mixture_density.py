"""Mixture densities of all components come from one product of a batch."""

import numpy as np
import pytest

from compovec.operators import mixture as G


@pytest.mark.parametrize("k, p", [(1, 3), (4, 3), (3, 1), (2, 18)])
def test_densities_match_one_component_at_a_time(monkeypatch, k, p):
    r = np.random.default_rng(k * 100 + p)
    q = r.normal(size=(k, p, p))
    m = G.Mixture(k, 0, -1, r.dirichlet(np.ones(k)), r.normal(size=(k, p)) * 5, q @ q.transpose(0, 2, 1) + 1e-2 * np.eye(p))
    x = r.normal(size=(700, p)) * 4
    want = np.empty((len(x), k))
    for c in range(k):
        d = x - m.means[c]
        quad = (d @ np.linalg.inv(m.covs[c]) * d).sum(1)
        want[:, c] = np.log(m.weights[c]) - 0.5 * (p * np.log(2 * np.pi) + np.linalg.slogdet(m.covs[c])[1] + quad)

    def no_solve(*args):
        raise AssertionError("a solve over all rows of a batch")

    monkeypatch.setattr(np.linalg, "solve", no_solve)
    np.testing.assert_allclose(m.log_density(x), want, rtol=1e-8, atol=1e-8)
    post, loglik = m.posterior(x)
    top = want.max(1, keepdims=True)
    np.testing.assert_allclose(loglik, (top + np.log(np.exp(want - top).sum(1, keepdims=True)))[:, 0], rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose(post, np.exp(want - loglik[:, None]), rtol=1e-6, atol=1e-8)
    assert m.posterior(x[:0])[0].shape == (0, k)
