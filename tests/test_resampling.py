"""Batched bootstrap mixtures, random selections and keyed permutations against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compovec.operators import bootstrap as N
from compovec.operators import mixture as G
from compovec.operators import resample as B


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.6, (70, 2)) for c in ((0, 0), (6, 1), (1, 7))]) + 1000.0
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3), x


def plain_em_step(x, w, weights, means, covs, ridge):
    p = x.shape[1]
    logp = np.stack([np.log(a) - 0.5 * (p * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m))
                     for a, m, c in zip(weights, means, covs)], 1)
    total = np.log(np.exp(logp).sum(1))
    r = np.exp(logp - total[:, None]) * w[:, None]
    n = r.sum(0)
    mu = r.T @ x / n[:, None]
    cov = np.stack([(r[:, k, None] * (x - mu[k])).T @ (x - mu[k]) / n[k] + ridge * np.eye(p) for k in range(len(n))])
    return (w * total).sum(), n / n.sum(), mu, cov


def test_one_pass_is_an_em_step_of_every_model(clusters):
    df, x = clusters
    mean, cov = x.mean(0), np.cov(x.T)
    rows = N.whitened(df, "x", ["id"], mean, cov)
    local = rows.toPandas()
    h, y = local["h"].to_numpy().view(np.uint64), np.vstack(local["x"])
    rng = np.random.default_rng(1)
    families = [N.Family(k, np.array([-1, 0, 3]), np.zeros(3, int), rng.dirichlet(np.ones(k), 3), rng.normal(size=(3, k, 2)), np.tile(np.eye(2), (3, k, 1, 1)),
                         np.zeros(3), np.zeros(3), np.zeros(3, bool)) for k in (2, 4)]
    for f, (sums, loglik, n) in zip(families, N.posterior_sums(rows, families)):
        want = [plain_em_step(y, N.poisson(h, f.draw[i:i + 1])[:, 0], f.weights[i], f.means[i], f.covs[i], 1e-6) for i in range(3)]
        f.update(sums, 1e-6)
        for i, (ll, a, m, c) in enumerate(want):
            assert np.allclose(loglik[i], ll) and np.allclose(f.weights[i], a) and np.allclose(f.means[i], m)
            few = sums[i, :, 0] <= 3
            assert np.allclose(f.covs[i][~few], c[~few], atol=1e-8)
        assert n[0] == len(x)


def test_draws_are_poisson_and_follow_keys_only():
    h = np.random.default_rng(2).integers(0, 1 << 63, 4000).astype(np.uint64)
    w = N.poisson(h, np.arange(-1, 30))
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < .02 and abs(w[:, 1:].var() - 1) < .03
    assert abs(np.corrcoef(w[:, 1:].T)[np.triu_indices(30, 1)]).max() < .08
    assert (N.poisson(h[::-1], np.arange(-1, 30)) == w[::-1]).all()


def test_stability_of_clear_clusters(clusters):
    df, x = clusters
    mean, cov = x.mean(0), np.cov(x.T)
    t = N.stability(df, "x", ["id"], mean, cov, [2, 3], n_boot=12, n_null=500, starts=4).set_index("k")
    assert t.loc[3, "boot_least"] > .97 and t.loc[3, "draws"] == 12 and t.loc[3, "p"] == 1 / 501 and abs(t.loc[3, "null_mean"]) < .02
    assert t.loc[2, "boot_mean"] < t.loc[3, "boot_mean"] and (t["converged"] == 1).all()
    # the same in other partitions, and as good as the fit of single models
    again = N.stability(df.repartition(1), "x", ["id"], mean, cov, [3], n_boot=12, n_null=500, starts=4).set_index("k")
    assert np.isclose(again.loc[3, "boot_mean"], t.loc[3, "boot_mean"])
    rows = N.whitened(df, "x", ["id"], mean, cov).persist()
    mine = N.best_starts(N.fit_families(rows, 2, [3], [-1], 4)[0])
    theirs = G.best_by_k(G.fit(rows, "x", ["h"], [(3, s, -1) for s in range(4)]))[3]
    assert abs(mine.loglik[0] - theirs.loglik) < 0.5


def plain_rank(v):
    return np.array([sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v])


def plain_similarity(v, to, measure):
    if measure == "spearman":
        v, to = plain_rank(v) - (len(v) + 1) / 2, plain_rank(to) - (len(v) + 1) / 2
    size = np.sqrt((v @ v) * (to @ to))
    return v @ to / size if size else np.nan


@pytest.mark.parametrize("gather", [20_000, 60])
def test_faithfulness_of_selections(spark, monkeypatch, gather):
    """Orders one by one in plain Python; a long report streams through in small pieces."""
    import hashlib
    from compovec.operators import selections as W
    monkeypatch.setattr(W, "GATHER", gather)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rng = np.random.default_rng(9)
    reports = {r: [(int(i), float(rng.integers(0, 4)), np.round(rng.dirichlet(np.ones(4)) * (rng.random(4) < .5), 3)) for i in rng.permutation(n)]
               for r, n in ((1, 1), (2, 4), (3, 12), (4, 700))}
    total = {r: sum(v for _, _, v in s) for r, s in reports.items()}
    gold = {1: None, 2: np.zeros(4), 3: rng.random(4), 4: np.array([1.0, 1.0, 1.0, 1.0])}
    sents = spark.createDataFrame([(r, i, w, v.tolist()) for r, s in reports.items() for i, w, v in s], "report_id long, sentence_idx long, importance double, vec array<double>")
    totals = spark.createDataFrame([(r, total[r].tolist(), None if gold[r] is None else gold[r].tolist()) for r in reports], "report_id long, full array<double>, gold array<double>")
    try:
        got = {(x.report_id, x.k, x.reference, x.measure): (x.top, x.rand, x.full) for x in W.faithfulness(sents.repartition(3), totals, [2, 5], 30).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hexed = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:7], 16)
    want = {}
    for r, s in reports.items():
        orders = [sorted(s, key=lambda x: (-x[1], x[0]))]
        orders += [sorted(s, key=lambda x: ((hexed(f"{r}-{x[0]}") * (1 + hexed(f"a-{b}")) + hexed(f"c-{b}")) % W.P, x[0])) for b in range(30)]
        for name, to in (("full", total[r]), ("gold", gold[r])):
            for m in ("cosine", "spearman") if to is not None else ():
                for k in (2, 5):
                    sims = [plain_similarity(np.round(sum(v for _, _, v in o[:k]), 9), np.round(to, 9), m) for o in orders]
                    drawn = [x for x in sims[1:] if not np.isnan(x)]
                    want[r, k, name, m] = (sims[0], np.mean(drawn) if drawn else np.nan, plain_similarity(np.round(total[r], 9), np.round(to, 9), m))
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert np.allclose([np.nan if v is None else v for v in got[key]], w, equal_nan=True), key


def test_keyed_permutations(spark):
    """Every draw is a permutation, near uniform; sums, shares and Rand indices equal those of the relabeled rows."""
    from compovec.operators import permutations as Y
    for n in (1, 2, 7, 64, 101):
        where = Y.places(np.arange(n), Y.round_keys(40, n), n)
        assert all(sorted(where[:, b]) == list(range(n)) for b in range(40))
    where = Y.places(np.arange(8), Y.round_keys(4000, 8), 8)
    counts = np.array([np.bincount(where[i], minlength=8) for i in range(8)])
    assert abs(counts - 500).max() < 110
    rng = np.random.default_rng(3)
    x, label = rng.normal(50, 2, (60, 3)), np.array(list("aaabb") * 12)
    df = spark.createDataFrame([(i, v.tolist(), str(c)) for i, (v, c) in enumerate(zip(x, label))], "id long, x array<double>, label string").repartition(4)
    number = {r.id: r.h for r in Y.numbered(df, ["id"], 60).collect()}
    assert sorted(number.values()) == list(range(60))
    where = Y.places(np.array([number[i] for i in range(60)]), Y.round_keys(30, 60), 60)
    group = np.searchsorted([36], where, side="right")
    eta = {r.b: r.eta2 for r in Y.permuted_eta2(df, "x", 3, "label", ["id"], 30).collect()}
    ari = {r.b: r.ari for r in Y.permuted_rand(df, "label", ["id"], 30).collect()}
    c = x - x.mean(0)
    for b in range(30):
        between = sum(np.sum(c[group[:, b] == g].sum(0) ** 2) / (group[:, b] == g).sum() for g in (0, 1))
        assert np.isclose(eta[b], between / (c**2).sum())
        table = np.array([[((label == a) & (group[:, b] == g)).sum() for g in (0, 1)] for a in "ab"], float)
        assert np.isclose(ari[b], G.rand_from_table(table))
    assert Y.permuted_eta2(df.limit(0), "x", 3, "label", ["id"], 5).count() == 0 and Y.permuted_rand(df.limit(0), "label", ["id"], 5).count() == 0


def test_shuffled_pairs_are_not_broadcast(spark):
    rows = spark.range(40).select(F.col("id"), F.col("id").alias("x"))
    pairs = B.shuffled_pairs(rows, rows.select("id", F.col("x").alias("y")), ["id"], 5)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 1
    assert "SortMergeJoin [b" in pairs._jdf.queryExecution().executedPlan().toString()
    got = pairs.toPandas()
    assert all(sorted(g["x"]) == sorted(g["y"]) == list(range(40)) for _, g in got.groupby("b")) and len(got) == 200


def test_rounds_of_shuffled_pairs_are_the_draws_of_one_call(spark):
    rows = spark.range(30).select(F.col("id"), F.col("id").alias("x"))
    pairs = lambda n, first: {tuple(r) for r in B.shuffled_pairs(rows, rows.select("id", F.col("x").alias("y")), ["id"], n, first).select("b", "x", "y").collect()}
    whole = pairs(5, 0)
    assert len(whole) == 150 and pairs(2, 0) | pairs(2, 2) | pairs(1, 4) == whole


def test_reconstruction_holds_a_round_of_pairs(spark, tmp_path, monkeypatch):
    """Pairs of few draws are held at a time, and the result is that of all draws at once."""
    from compovec.plans import load_catalogue, scores
    rng = np.random.default_rng(2)
    n = 30
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(i, "n", 1, 10.0 + i, "BUILDING") for i in range(1, n + 1)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "customer")
    write([(o, int(rng.integers(1, n + 1)), "F", float(rng.integers(1, 999))) for o in range(4 * n)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", "orders")
    write([(o, int(rng.integers(1, 99)), int(rng.integers(1, 99)), j, float(rng.integers(1, 50))) for o in range(4 * n) for j in range(5)],
          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double", "lineitem")
    asked, real = [], B.shuffled_pairs
    monkeypatch.setattr(B, "shuffled_pairs", lambda left, right, key, draws, first=0: asked.append(draws) or real(left, right, key, draws, first))
    run = lambda: load_catalogue()["reconstruction_permutation"].run(spark, str(tmp_path)).first().asDict()
    whole = run()
    monkeypatch.setattr(scores, "PAIRS_HELD", 70 * n)
    parts = run()
    assert asked[0] == 200 and len(asked) > 2 and sum(asked[1:]) == 200 and max(asked[1:]) < 200
    assert parts["p"] == whole["p"] and np.allclose([parts[k] for k in ("observed", "null_mean")], [whole[k] for k in ("observed", "null_mean")], rtol=1e-9)


def test_a_report_is_ranked_in_one_table(monkeypatch):
    """Average ranks by the plain definition; the sums of all draws, the whole report and the references are ranked by one call."""
    from compovec.operators import selections as W
    rng = np.random.default_rng(3)
    for v in (rng.integers(0, 6, (50, 19)).astype(float), rng.integers(0, 6, (3, 150)).astype(float), np.ones(5)):
        want = (v[..., None, :] < v[..., :, None]).sum(-1) + ((v[..., None, :] == v[..., :, None]).sum(-1) + 1) / 2
        assert np.array_equal(W.ranks(v), want)
    calls, real = [], W.ranks
    monkeypatch.setattr(W, "ranks", lambda v: calls.append(v.shape) or real(v))
    a, c = W.seeds(6)
    vec = rng.integers(0, 2, (30, 7)).astype(float)
    rows = list(W.one_report(np.arange(30), rng.integers(0, 2**28, 30), rng.random(30), vec, vec.sum(0), {"full": vec.sum(0), "gold": vec[:9].sum(0)}, [2, 4], a, c, ("spearman",)))
    assert calls == [(2 * 7 + 3, 7)] and len(rows) == 4


def test_tiles_of_mixtures_stay_small(monkeypatch):
    """The arrays of a tile take little memory however many rows and models a pass has; sums do not depend on the tiles."""
    import tracemalloc
    from types import SimpleNamespace as Any
    rng = np.random.default_rng(5)
    k, x, h = 4, rng.normal(size=(3_000, 3)), rng.integers(0, 2**62, 3_000).astype(np.uint64)
    draw, seed = np.repeat(np.arange(-1, 59), 10), np.tile(np.arange(10), 60)
    m = len(draw)
    family = N.Family(k, draw, seed, np.full((m, k), 1 / k), rng.normal(size=(m, k, 3)), np.tile(np.eye(3), (m, k, 1, 1)), np.full(m, -np.inf), np.zeros(m), np.zeros(m, bool))
    peak = []

    def tile_sums(df, work, shapes):
        out = [np.zeros(n) for n in shapes]
        tracemalloc.start()
        work(h, x, out)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return out

    monkeypatch.setattr(N, "tile_sums", tile_sums)
    df = Any(sparkSession=Any(sparkContext=Any(broadcast=lambda v: Any(value=v, unpersist=lambda: None))))
    got = N.posterior_sums(df, [family])[0]
    assert peak[0] < 12 << 20
    monkeypatch.setattr(N, "TILE_MODELS", m)
    monkeypatch.setattr(N, "TILE_CELLS", 1 << 24)
    assert all(np.allclose(a, b) for a, b in zip(got, N.posterior_sums(df, [family])[0]))


def test_only_named_measures_are_worked_out(monkeypatch):
    from compovec.operators import selections as W
    rng = np.random.default_rng(6)
    n, refs = 30, {"full": rng.random(5), "gold": None}
    one = (np.arange(n), rng.integers(0, 2**28, n), rng.random(n), np.round(rng.random((n, 5)) * (rng.random((n, 5)) < .4), 1), rng.random(5), refs, [3, 9], *W.seeds(20))
    both = list(W.one_report(*one))
    assert [r for r in both if r[2] == "spearman"] == list(W.one_report(*one, ("spearman",)))
    v = rng.integers(0, 4, (3, 2, 6)).astype(float)
    assert np.array_equal(W.ranks(v), [[plain_rank(r) for r in x] for x in v])
    monkeypatch.setattr(W, "ranks", None)
    assert [r for r in both if r[2] == "cosine"] == list(W.one_report(*one, ("cosine",)))
