import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from compovec.functions import arrays as A
from compovec.functions import special as S
from compovec.operators import agreement as E
from compovec.operators import cluster as K
from compovec.operators import composition as C
from compovec.operators import coordinates as Z
from compovec.operators import importance as I
from compovec.operators import mixture as G
from compovec.operators import moments as M
from compovec.operators import ranks as R
from compovec.operators import regress
from compovec.operators import resample as B
from compovec.operators import splits as P
from compovec.operators import tables as T

rng = np.random.default_rng(7)


def skewed(spark, n=900):
    """A third of all rows share one group and one value."""
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 5}", float(0 if i % 3 == 0 else rng.integers(0, 40))) for i in range(n)]
    return spark.createDataFrame(rows, "id int, g string, x double"), rows


@pytest.mark.parametrize("buckets", [1, 16])
def test_ranks_percentiles_and_running_sums_are_exact_under_skew(spark, buckets):
    df, rows = skewed(spark)
    x = np.array([r[2] for r in rows])
    want = {v: (x < v).sum() + ((x == v).sum() + 1) / 2 for v in np.unique(x)}
    got = {r["x"]: r["rank"] for r in R.value_ranks(df, "x", buckets=buckets).collect()}
    assert got == want
    p = R.percentiles(df, "x", [0.1, 0.5, 0.975], names=["a", "b", "c"], buckets=buckets).first()
    assert np.allclose([p["a"], p["b"], p["c"]], np.percentile(x, [10, 50, 97.5]))


def test_ranks_do_not_depend_on_the_number_of_buckets(spark):
    nan, inf = float("nan"), float("inf")
    values = {"narrow": [1e6 + i * 1e-7 for i in range(40)], "outlier": [1e300, -1e300, *[i / 7 for i in range(-20, 20)]],
              "special": [nan, inf, -inf, 0.0, 1.0, None, 2.0, 2.0], "one": [3.0], "none": [None, None], None: [2.0, 1.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, x double")
    for g, vs in values.items():
        order = sorted((v for v in vs if v is not None), key=lambda v: (v != v, v if v == v else 0))
        want = [(v, order.index(v) + (order.count(v) + 1) / 2) for v in dict.fromkeys(order)]
        for buckets in (1, 4, 4096):
            r = R.value_ranks(df, "x", ["g"], buckets).where(F.col("g").eqNullSafe(F.lit(g))).collect()
            assert sorted((repr(x["x"]), x["rank"]) for x in r) == sorted((repr(v), k) for v, k in want), (g, buckets)
    empty = df.where("false")
    assert R.value_ranks(empty, "x").count() == 0 and R.auroc(empty.withColumn("y", F.lit(True)), "y", "x", ["g"]).count() == 0
    scored = spark.createDataFrame([(True, nan), (False, 0.5), (True, 0.2), (False, None)], "y boolean, x double")
    assert {R.auroc(scored, "y", "x", buckets=b).first()["auroc"] for b in (1, 4, 4096)} == {0.5}


@pytest.mark.parametrize("buckets", [1, 8])
def test_auroc_spearman_signed_rank(spark, buckets):
    n = 300
    y, s = rng.integers(0, 2, n), np.round(rng.normal(size=n), 1)
    v = np.round(s + rng.normal(size=n), 1)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(b - c)) for a, b, c in zip(y, s, v)], "y int, s double, v double, d double")
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert math.isclose(R.auroc(df, "y", "s", buckets=buckets).first()["auroc"], auc, rel_tol=1e-12)
    rank = lambda z: np.array([(z < t).sum() + ((z == t).sum() + 1) / 2 for t in z])
    rho = np.corrcoef(rank(s), rank(v))[0, 1]
    assert math.isclose(R.spearman(df, "s", "v", buckets=buckets).first()["rho"], rho, rel_tol=1e-9)
    d = np.round(s - v, 12)
    d2 = d[d != 0]
    df = df.withColumn("d", F.round("d", 12))
    r = rank(np.abs(d2))
    got = R.signed_rank(df, "d", buckets=buckets).first()
    assert math.isclose(got["w"], min(r[d2 > 0].sum(), r[d2 < 0].sum()))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    q = {r["i"]: r["q"] for r in T.benjamini_hochberg(df).collect()}
    assert np.allclose([q[0], q[1], q[2], q[3]], [0.04, 0.16 / 3, 0.16 / 3, 0.5]) and q[4] is None


def compositions(spark, n=240, d=5):
    p = rng.dirichlet(np.ones(d), n)
    rows = [(i, "P" if i % 3 == 0 else "A", p[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id int, report_type string, prop array<double>"), p, np.array([r[1] for r in rows])


def test_log_ratio_coordinates_and_residuals(spark):
    df, p, t = compositions(spark)
    c = np.log(p + 1e-6)
    c -= c.mean(1, keepdims=True)
    v = Z.helmert(5)
    assert np.allclose(v.T @ v, np.eye(4)) and np.allclose(v @ v.T, np.eye(5) - 1 / 5)
    rows = Z.residualise(Z.add_coordinates(df, 5), {"ilr": 4}).orderBy("id").collect()
    ilr = np.array([r["ilr"] for r in rows])
    assert np.allclose([r["clr"] for r in rows], c) and np.allclose(ilr, c @ v)
    res = np.array([r["ilr_res"] for r in rows])
    assert np.allclose([res[t == g].mean(0) for g in "AP"], 0)


def test_moments_axes_distances_and_leave_one_out(spark):
    df, p, t = compositions(spark)
    c = Z.add_coordinates(df, 5)
    x = np.array([r["ilr"] for r in c.orderBy("id").collect()])
    m = M.moments(c, "ilr")
    assert np.allclose(m.cov, np.cov(x, rowvar=False)) and m.n == len(x)
    d = np.array([r["distance"] for r in M.distance(c, "ilr", m).orderBy("id").collect()])
    dev = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", dev, np.linalg.inv(np.cov(x, rowvar=False)), dev))
    assert np.allclose(d, want)
    b = M.pca(m)
    s = M.scores(c, b, "ilr").withColumn("d2", M.score_d2("scores", b)).orderBy("id").collect()
    assert np.allclose(np.sqrt([r["d2"] for r in s]), want)
    groups = M.collect_moments(c, "ilr", ["report_type"])
    loo = M.leave_one_out(c.select("id", "report_type", F.lit(True).alias("inside"), "ilr"), "ilr", "report_type", groups, "inside")
    got = {r["id"]: r["loo_distance"] for r in loo.collect()}
    for i in (0, 1, 17):
        keep = np.arange(len(x)) != i
        res = np.concatenate([x[keep & (t == g)] - x[keep & (t == g)].mean(0) for g in "AP"])
        e = x[i] - x[keep & (t == t[i])].mean(0)
        assert math.isclose(got[i], math.sqrt(e @ np.linalg.inv(np.cov(res, rowvar=False)) @ e), rel_tol=1e-8)


def test_mixture_and_t_recover_structure(spark):
    x = np.concatenate([rng.normal(-4, 1, (200, 2)), rng.normal(4, 1, (200, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3).persist()
    models = G.fit(df, "v", ["id"], [(1, 0, -1), (2, 0, -1), (2, 1, -1)], max_iter=30)
    assert all(b >= a - 1e-6 for m in models for a, b in zip(m.trail, m.trail[1:]))
    best = G.best_by_k(models)
    assert best[2].bic < best[1].bic
    assert G.rand_indices(df, "v", [models[1], models[2]]) == [1.0]
    lab = {r["id"]: r["mode"] for r in G.assign(df, "v", best[2]).collect()}
    assert len({lab[i] for i in range(200)}) == 1 and lab[0] != lab[399]
    m = M.moments(df, "v")
    t = G.fit_t(df, "v", m.mean, m.cov, tol=1e-3, max_iter=40)
    assert t.nu > 5 and np.isfinite(t.loglik)
    null = G.null_rand_indices(np.array([200, 200]), 200)
    assert abs(null.mean()) < 0.02


def test_hash_groups_have_exact_sizes_and_follow_hash_order(spark):
    import hashlib
    df = spark.range(500).select(F.col("id").cast("int").alias("id"))
    for parts in (1, 7):
        rows = B.hash_groups(df.repartition(parts), [120, 300, 80], 3, ["id"]).collect()
        assert len(rows) == 1500
        for b in range(3):
            order = sorted(range(500), key=lambda i: hashlib.md5(f"{b}-{i}".encode()).hexdigest())
            want = {i: 0 if r < 120 else 1 if r < 420 else 2 for r, i in enumerate(order)}
            assert {r["id"]: r["grp"] for r in rows if r["b"] == b} == want


def test_random_k_halves_and_weighted_k(spark):
    df, rows = skewed(spark, 300)
    r = B.random_k(df, 4, 2, ["g"], ["id"]).groupBy("g", "b").count().collect()
    assert {x["count"] for x in r} == {4}
    h = B.halves(df, ["g"], ["id"]).groupBy("g").agg(F.count_if(F.col("half") == 1).alias("a"), F.count("*").alias("n")).collect()
    assert all(x["a"] == x["n"] // 2 for x in h)
    few = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 0.0), ("b", 1, 0.0), ("b", 2, 0.0)], "g string, id int, w double")
    w = B.weighted_k(few, "w", 4, ["g"], ["id"]).groupBy("g").count().collect()
    assert {x["count"] for x in w} == {4}


def test_nobody_is_in_two_folds(spark):
    rows = [(i, f"p{i // 2 if i < 200 else 7}", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, person string, label int")
    f = P.stratified_group_folds(df, "person", "label", 5)
    assert f.groupBy("person").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0 and f.count() == 300


def test_mean_cosine_closed_form_and_silhouettes(spark):
    x = rng.normal(size=(40, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(u)], "id int, u array<double>, c int")
    want = np.mean([u[i] @ u[j] for i, j in combinations(range(40), 2)])
    assert math.isclose(K.mean_cosine(df, "u", 3).first()["cosine"], want, rel_tol=1e-9)
    c = np.arange(40) % 3
    for fn, dist in ((lambda: K.silhouette_squared(df, "u", "c", 3), lambda a, b: ((a - b) ** 2).sum(-1)),
                     (lambda: K.silhouette_exact(df, "u", "c", "id", block_rows=9), lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)))):
        got = {r["id"]: r["silhouette"] for r in fn().collect()}
        for i in (0, 13, 39):
            d = dist(u[i], u)
            a = d[c == c[i]].sum() / ((c == c[i]).sum() - 1)
            b = min(d[c == k].mean() for k in range(3) if k != c[i])
            assert math.isclose(got[i], (b - a) / max(a, b), rel_tol=1e-8)


def test_rand_index_and_kappa_limits(spark):
    df = spark.createDataFrame([(i, i % 3, i % 4) for i in range(60)], "id int, a int, b int")
    assert E.adjusted_rand(df, "a", "a").first()["ari"] == 1.0
    votes = spark.createDataFrame([("r", i, v, E.NONE if i % 2 else "test_scores") for i in range(4) for v in range(5)], "report_id string, sentence_idx int, vote_no int, vote string")
    t = E.vote_table(votes)
    assert E.fleiss_kappa(t, 20).first()["kappa"] == pytest.approx(1.0)
    assert E.modal_agreement(t).first()["unanimity"] == 1.0


def test_composition_mass_and_guards(spark):
    ids = ["a", "b", "c"]
    sel = spark.createDataFrame([("r", 1, 0), ("r", 2, 1), ("r", 3, 2), ("q", 1, 0)], "report_id string, rank int, sentence_idx int")
    lab = spark.createDataFrame([("r", 0, [("a", 0.9), ("b", 0.1), ("x", 1.0)]), ("r", 1, [("x", 1.0)]), ("q", 0, [("x", 0.0)])],
                                "report_id string, sentence_idx int, labels array<struct<domain_id:string,confidence:double>>")
    m = C.match(sel, lab, ids)
    s = C.statistics(m).first()
    assert (s["total_selected"], s["matched"], s["no_label"], s["no_active_domain"], s["assignments"], s["discarded"]) == (4, 1, 1, 2, 2, 3)
    v = {r["report_id"]: r["prop"] for r in C.proportions(C.dense(C.mass(m, "confidence"), ids, reports=sel)).collect()}
    assert np.allclose(v["r"], [0.9, 0.1, 0.0]) and v["q"] == [0.0, 0.0, 0.0]
    eq = C.proportions(C.dense(C.mass(m), ids), drop=1).first()
    assert eq["prop"] == [1.0, 0.0] and C.details(m).filter("report_id = 'r'").first()["domains_found"] == ["a", "b"]


def test_top_k_ties_and_short_reports(spark):
    e = spark.createDataFrame([("r", 0, 1, 2.0), ("r", 1, 0, 2.0), ("r", 2, 2, 1.0), ("s", 0, 0, 1.0)], "report_id string, q int, k int, w double")
    top = I.top_k(I.importance(e), 2).orderBy("report_id", "rank").collect()
    assert [(r["report_id"], r["sentence_idx"]) for r in top] == [("r", 0), ("r", 1), ("s", 0)]
    with pytest.raises(ValueError):
        I.importance(e, "diagonal")


def test_ridge_from_fold_moments_matches_direct_solves():
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=200))[:, None]
    f = np.arange(200) % 5
    z = np.hstack([x, y])
    mo = {k: M.Moments((f == k).sum(), z[f == k].mean(0), (z[f == k] - z[f == k].mean(0)).T @ (z[f == k] - z[f == k].mean(0))) for k in range(5)}
    r2, fits = regress.ridge_cv(mo, 3, alphas=[0.1])
    pred = np.empty(200)
    for k in range(5):
        tr = f != k
        mu, my = x[tr].mean(0), y[tr].mean()
        beta = np.linalg.solve((x[tr] - mu).T @ (x[tr] - mu) + 0.1 * np.eye(3), (x[tr] - mu).T @ (y[tr, 0] - my))
        pred[f == k] = (x[f == k] - mu) @ beta + my
    want = 1 - ((y[:, 0] - pred) ** 2).sum() / ((y[:, 0] - y.mean()) ** 2).sum()
    assert math.isclose(r2[0], want, rel_tol=1e-9)


def test_tail_functions_against_known_values():
    assert math.isclose(S.chi2_ppf(0.99, 18), 34.80530573, rel_tol=1e-7)
    assert np.allclose(S.chi2_cdf([3.84145882], 1), [0.95])
    assert np.allclose(S.t_two_sided([2.2281388520], 10), [0.05])
    assert math.isclose(S.digamma(1.0), -0.5772156649, rel_tol=1e-9)
    assert np.allclose(S.normal_two_sided([1.959963985]), [0.05])


def test_moments_do_not_cancel(spark):
    rng = np.random.default_rng(3)
    x = 1e6 + 0.01 * rng.standard_normal((4000, 2))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(5)
    from compovec.operators import moments as MM
    m = MM.moments(df, "v")
    want = np.cov((x - 1e6).T)                      # the differences are exact
    assert np.abs(m.cov - want).max() <= 1e-8 * want.max()
    rows = {(r.i, r.j): r["cov"] for r in MM.covariance_frame(df, "v", 2).collect()}
    assert abs(rows[0, 1] - want[0, 1]) <= 1e-8 * want.max()


def test_leave_one_out_errors_match_refits(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 3)) + 100
    y = x @ r.normal(size=(3, 2)) + r.normal(size=(40, 2))
    f, z = np.arange(40) % 4, np.hstack([x, y])
    part = lambda v: M.Moments(len(v), v.mean(0), (v - v.mean(0)).T @ (v - v.mean(0)))
    mo = {k: part(z[f == k]) for k in range(4)}
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(f, z)], "fold int, v array<double>").repartition(3)
    alphas = [0.1, 10.0]
    got = regress.loo_errors(df, "v", {(): mo}, 3, alphas=alphas)[()]
    for k in range(4):
        tx, ty = x[f != k], y[f != k]
        for i, a in enumerate(alphas):
            want = np.zeros(2)
            for j in range(len(tx)):
                keep = np.arange(len(tx)) != j
                # an unpenalised intercept: the centre moves with the row that is left out
                mx, my = tx[keep].mean(0), ty[keep].mean(0)
                beta = np.linalg.solve((tx[keep] - mx).T @ (tx[keep] - mx) + a * np.eye(3), (tx[keep] - mx).T @ (ty[keep] - my))
                want += (ty[j] - my - (tx[j] - mx) @ beta) ** 2
            assert np.allclose(got[k][i], want, rtol=1e-8)


def test_leave_one_out_of_single_rows_and_unknown_groups_is_null(spark):
    rows = [(i, "a", True, [float(i), float(i * i % 7)]) for i in range(8)] + [(8, "one", True, [1.0, 2.0]), (9, "new", False, [1.0, 2.0]), (10, None, False, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, g string, inside boolean, v array<double>")
    groups = M.collect_moments(df.where("inside"), "v", ["g"])
    got = {r["id"]: r["loo_distance"] for r in M.leave_one_out(df, "v", "g", groups, "inside").collect()}
    assert got[8] is None and got[9] is None and got[10] is None and all(got[i] > 0 for i in range(8))


def test_chi_square_quantiles_invert_the_distribution():
    for df in (1.0, 3.0, 18.0):
        q = np.array([1e-4, 0.01, 0.3, 0.5, 0.99, 0.9999])
        assert np.allclose(S.chi2_cdf(S.chi2_quantiles(q, df), df), q, atol=1e-10)


def test_mixture_with_far_mean_and_small_component(spark):
    r = np.random.default_rng(11)
    x = np.vstack([r.normal(0, 1, (600, 2)), r.normal(12, 0.5, (12, 2))]) + 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(4).persist()
    m = G.best_by_k(G.fit(df, "v", ["id"], [(2, s, -1) for s in range(4)]))[2]
    assert m.converged and math.isclose(m.weights.min(), 12 / 612, rel_tol=1e-3)
    assert not G.fit(df, "v", ["id"], [(2, 0, -1)], max_iter=1)[0].converged


def test_histogram_keeps_all_rows(spark):
    from compovec.operators import tables
    values = [-3.0, 0.0, 1.0, 7.0, 99.0, 105_000.0, 250_000.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = {r.bin: (r.n, r.density) for r in tables.histogram(df, "x", None, None, 40).collect()}
    n, edges = np.histogram(values, 40)
    assert {k: v[0] for k, v in got.items()} == {i: c for i, c in enumerate(n) if c}
    assert sum(v[0] for v in got.values()) == len(values)
    assert all(abs(v[1] - n[k] / len(values) / (edges[1] - edges[0])) < 1e-12 for k, v in got.items())
    assert [(r.bin, r.n) for r in tables.histogram(df.filter("x = 7"), "x", None, None, 40).collect()] == [(20, 1)]


def test_exact_silhouette_takes_each_pair_of_blocks_once(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(60, 3)), np.full((4, 3), 1e6), np.full((4, 3), 1e6) + 1e-3])
    c = [int(i) for i in rng.integers(0, 3, 68)]
    df = spark.createDataFrame([(i, c[i] if i % 17 else None, v.tolist()) for i, v in enumerate(x)], "id long, c int, u array<double>")
    s = K.silhouette_exact(df, "u", "c", "id", block_rows=10)
    assert "sequence(own" in s._jdf.queryExecution().analyzed().toString()      # not every block against every block
    got = {r["id"]: r["silhouette"] for r in s.collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    lab = np.array([c[i] if i % 17 else -1 for i in range(68)])
    for i in range(68):
        of = {k: d[i, lab == k].sum() / ((lab == k).sum() - (k == lab[i])) for k in range(3)}
        a = of.pop(lab[i], None)
        b = min(of.values())
        assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b), abs=1e-9)
