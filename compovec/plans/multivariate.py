"""Covariance, principal axes, distances, tails, mixtures and individual profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from compovec.functions import arrays as A
from compovec.functions import special
from compovec.operators import cluster as K
from compovec.operators import coordinates as Z
from compovec.operators import bootstrap as N
from compovec.operators import mixture as G
from compovec.operators import moments as M
from compovec.operators import ranks as R
from compovec.plans import fixtures as X
from compovec.plans.cohort import ALL, D, cohort, compositions
from compovec.plans.coordinates import PSEUDO, with_size
from compovec.plans.registry import query
from compovec.plans.sqlkit import cte, rnd, sql
from compovec.plans.vectors import rounded
from compovec.session import materialise

P = D - 1


@query("covariance", "STA-1",
       sql(f"SELECT a.i, b.i AS j, {rnd('covar_samp(a.ilr_res, b.ilr_res)', 7)} AS cov FROM ilr a JOIN ilr b USING (report_id) WHERE a.i <= b.i GROUP BY ALL", "ilr"))
def _(spark, sf):
    return rounded(M.covariance_frame(cohort(spark, sf), "ilr_res", P), "cov", digits=7)


@query("covariance_by_type", "STA-1",
       sql(f"SELECT a.report_type, a.i, b.i AS j, {rnd('covar_samp(a.ilr, b.ilr)', 6)} AS cov FROM ilr a JOIN ilr b USING (report_id) WHERE a.i <= b.i GROUP BY ALL", "ilr"))
def _(spark, sf):
    return rounded(M.covariance_frame(cohort(spark, sf), "ilr", P, ["report_type"]), "cov", digits=6)


def axes(spark, sf, vec="ilr_res"):
    # read at least twice: once for the moments, once for the scores
    c = cohort(spark, sf).persist()
    m = M.moments(c, vec)
    return c, m, M.pca(m)


def frame(spark, rows: list[dict]):
    """A small result table from driver-side summaries."""
    clean = [{k: (v.item() if isinstance(v, np.generic) else v) for k, v in r.items()} for r in rows]
    # a figure that no row has would leave its column without a type
    known = {k for r in clean for k, v in r.items() if v is not None}
    return spark.createDataFrame([{k: v for k, v in r.items() if k in known} for r in clean])


@query("principal_axes", "STA-2 WIN-10")
def _(spark, sf):
    _, _, b = axes(spark, sf)
    total = np.cumsum(b.ratio)
    return frame(spark, [dict(axis=i, eigenvalue=float(b.eigenvalues[i]), ratio=float(b.ratio[i]), cumulative=float(total[i])) for i in range(P)])


@query("principal_scores", "STA-2")
def _(spark, sf):
    c, _, b = axes(spark, sf)
    s = M.scores(c, b, "ilr_res", 3)
    return s.select("report_id", *[F.get("scores", F.lit(i)).alias(f"pc{i + 1}") for i in range(3)])


@query("embedding_plane", "STA-2")
def _(spark, sf):
    e = X.table(spark, sf, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    s = M.scores(e, M.pca(M.moments(e, "x")), "x", 2)
    return s.select("vec_id", "label", F.get("scores", F.lit(0)).alias("pc1"), F.get("scores", F.lit(1)).alias("pc2"))


@query("effective_dimension", "STA-3")
def _(spark, sf):
    c = cohort(spark, sf)
    adjusted, raw = M.pca(M.moments(c, "ilr_res")), M.pca(M.moments(c, "ilr"))
    one = M.pca(M.moments(c.filter("report_type = 'A'"), "ilr"))
    return frame(spark, [dict(cohort=n, **M.effective_dimension(b)) for n, b in (("adjusted", adjusted), ("raw", raw), ("type_a", one))])


def scored(spark, sf):
    c, m, b = axes(spark, sf)
    s = M.scores(c, b, "ilr_res")
    s = s.withColumn("d2_full", M.score_d2("scores", b)).withColumn("d2_lead", M.score_d2("scores", b, 0, 3))
    return s.withColumn("d2_rest", M.score_d2("scores", b, 3)), m, b


@query("prototype_distances", "STA-4 STA-6")
def _(spark, sf):
    s, _, _ = scored(spark, sf)
    s = M.distance(s, "ilr", M.moments(s, "ilr"), "raw")
    return s.select("report_id", "report_type", F.sqrt("d2_full").alias("full"), F.sqrt("d2_lead").alias("lead"), F.sqrt("d2_rest").alias("rest"), "raw")


cte("dev_out", "SELECT o.report_id, report_type, i, o.ilr - m.mean AS r FROM ilr_out o JOIN (SELECT report_type, i, avg(ilr) AS mean FROM ilr GROUP BY ALL) m USING (report_type, i)", "ilr_out", "ilr")
cte("d2_out", "SELECT report_id, any_value(a.report_type) AS report_type, sum(a.r * b.r * w) AS d2 FROM dev_out a JOIN dev_out b USING (report_id) JOIN inverse v ON v.i = a.i AND v.j = b.i GROUP BY 1", "dev_out", "inverse")


@query("leave_one_out_distances", "STA-5",
       sql("SELECT report_id, report_type, true AS inside, " + rnd("sqrt((total - 2) * c * c * q / (1 - c * q))", 6) + " AS loo_distance FROM (SELECT report_id, report_type, d2 / (count(*) OVER () - 1) AS q, "
           "count(*) OVER () AS total, count(*) OVER (PARTITION BY report_type) / (count(*) OVER (PARTITION BY report_type) - 1e0) AS c FROM d2) UNION ALL SELECT report_id, report_type, false, " + rnd("sqrt(d2)", 6) + " FROM d2_out",
           "d2", "d2_out"))
def _(spark, sf):
    both = Z.add_coordinates(compositions(spark, sf), D).withColumn("inside", F.col("label") == 1)
    groups = M.collect_moments(both.filter("inside"), "ilr", ["report_type"])
    rows = both.select("report_id", "report_type", "inside", "ilr")
    return rounded(M.leave_one_out(rows, "ilr", "report_type", groups, "inside"), "loo_distance", digits=6)


def kurtosis_rows(s, parts, n):
    """Mardia tests of several squared-distance columns from one aggregation and one percentile table."""
    cols = F.array(*[F.struct(F.lit(name).alias("part"), F.lit(p).alias("p"), F.col(c).alias("d2")) for name, c, p in parts])
    long = s.select(F.inline(cols))
    q = R.percentiles(long, "d2", [0.99], ["part"], ["q99"])
    g = long.groupBy("part").agg(F.avg(F.col("d2") * F.col("d2")).alias("beta2"), F.count("*").alias("n")).join(q, "part").collect()
    dims = {name: p for name, _, p in parts}
    return [dict(part=r["part"], n=r["n"], **M.mardia(r["beta2"], r["q99"], r["n"], dims[r["part"]])) for r in g]


@query("kurtosis_tests", "STA-7")
def _(spark, sf):
    s, m, _ = scored(spark, sf)
    return frame(spark, kurtosis_rows(s, [("full", "d2_full", P), ("lead", "d2_lead", 3), ("rest", "d2_rest", P - 3)], m.n))


FAR = float(special.chi2_ppf(0.99, P))


@query("tail_share", "STA-8 FN-3",
       sql("SELECT " + rnd(f"avg(CASE WHEN d2 > {FAR!r} THEN 1e0 ELSE 0e0 END)") + " AS share, " + rnd(f"sqrt({FAR!r})") + " AS reference, count(*) AS n FROM d2", "d2"))
def _(spark, sf):
    s, _, _ = scored(spark, sf)
    return rounded(s.agg(F.avg((F.col("d2_full") > FAR).cast("double")).alias("share"), F.lit(float(np.sqrt(FAR))).alias("reference"), F.count("*").alias("n")), "share", "reference")


@query("distance_distribution_test", "STA-9 WIN-11 FN-3")
def _(spark, sf):
    s, _, _ = scored(spark, sf)
    s = s.select("d2_full").withColumn("cdf", special.chi2_cdf_udf(F.col("d2_full"), F.lit(float(P))))
    k = K.ks_uniformity(s, "d2_full", "cdf").first()
    return frame(spark, [dict(statistic=k["statistic"], n=k["n"], p=special.kolmogorov_sf(k["statistic"] * np.sqrt(k["n"])))])


@query("quantile_positions", "WIN-11",
       sql("SELECT report_id, size, " + rnd("(row_number() OVER (ORDER BY size, report_id) - 0.5) / count(*) OVER ()", 9) + " AS position FROM sizes", "sizes"))
def _(spark, sf):
    return positions(spark, sf)


@query("chi_square_pairs", "WIN-11 FN-3")
def _(spark, sf):
    """Squared distances in order against the chi-square quantiles of their positions."""
    p = positions(spark, sf)
    return p.select("report_id", "position", (F.col("size") * F.col("size")).alias("d2"), special.chi2_quantile_udf("position", F.lit(float(P))).alias("quantile"))


@query("profile_summary", "STA-36 WIN-8",
       sql("SELECT count(*) AS n, count(*) FILTER (report_type = 'A') AS n_a, count(*) FILTER (report_type = 'P') AS n_p, " + rnd("avg(size)", 6) + " AS mean, " + rnd("any_value(t)", 6) + " AS p90, max(size) AS largest, "
           "count(*) FILTER (size >= t) AS n_tail FROM sizes, (SELECT quantile_cont(size, 0.9) AS t FROM sizes)", "sizes"))
def _(spark, sf):
    c = with_size(cohort(spark, sf)).select("report_type", "size", F.lit(1).alias("_k"))
    j = c.join(F.broadcast(R.percentiles(c, "size", [0.9], ["_k"], ["t"])), "_k")        # one row
    o = j.agg(F.count("*").alias("n"), F.count_if(F.col("report_type") == "A").alias("n_a"), F.count_if(F.col("report_type") == "P").alias("n_p"), F.avg("size").alias("mean"),
              F.max("t").alias("p90"), F.max("size").alias("largest"), F.count_if(F.col("size") >= F.col("t")).alias("n_tail"))
    return rounded(o, "mean", "p90", digits=6)


def positions(spark, sf):
    """Plotting position of every report in the order of its distance."""
    c = with_size(cohort(spark, sf)).select("report_id", "size")
    r = R.running(R.distinct_values(c, "size", [], {"n": F.lit(1)}), "size", [], ["n"])
    from pyspark.sql import Window
    j = c.join(r, "size").withColumn("_i", F.row_number().over(Window.partitionBy("size").orderBy("report_id")))
    pos = (F.col("run_n") - F.col("n") + F.col("_i") - 0.5) / F.col("total_n")
    return rounded(j.select("report_id", "size", pos.alias("position")), "position", digits=9)


KS, STARTS, SEEDS = range(2, 9), 10, 30


def lead_frame(spark, sf):
    """Cached leading scores; a few numbers per report."""
    c, _, b = axes(spark, sf)
    s = M.scores(c, b, "ilr_res", 3).select("report_id", F.col("scores").alias("lead")).persist()
    m = M.moments(s, "lead")
    return s, m


@query("mixture_selection", "STA-10")
def _(spark, sf):
    s, m = lead_frame(spark, sf)
    best = G.best_by_k(G.fit(s, "lead", ["report_id"], [(k, seed, -1) for k in KS for seed in range(STARTS)]))
    top = min(best.values(), key=lambda x: x.bic).k
    out = frame(spark, [dict(k=k, bic=float(x.bic), loglik=float(x.loglik), smallest=float(x.weights.min()), chosen=k == top) for k, x in sorted(best.items())])
    s.unpersist()
    return out


@query("heavy_tail_versus_mixture", "STA-11")
def _(spark, sf):
    s, m = lead_frame(spark, sf)
    t = G.fit_t(s, "lead", m.mean, m.cov)
    best = G.best_by_k(G.fit(s, "lead", ["report_id"], [(k, seed, -1) for k in KS for seed in range(STARTS)]))
    out = frame(spark, [dict(k=k, mixture_bic=float(x.bic), t_bic=float(t.bic), nu=float(t.nu), delta=float(x.bic - t.bic)) for k, x in sorted(best.items())])
    s.unpersist()
    return out


@query("seed_stability", "STA-14 JN-11")
def _(spark, sf):
    s, _ = lead_frame(spark, sf)
    rows = []
    models = G.fit(s, "lead", ["report_id"], [(k, seed, -1) for k in KS for seed in range(SEEDS)])
    for k in KS:
        a = G.rand_indices(s, "lead", [m for m in models if m.k == k])
        rows.append(dict(k=k, pairs=len(a), seed_ari_mean=float(np.mean(a)), seed_ari_sd=float(np.std(a))))
    s.unpersist()
    return frame(spark, rows)


BOOT_DRAWS, NULL_DRAWS = 1_000, 10_000


@query("bootstrap_stability", "STA-15 STA-16")
def _(spark, sf):
    """Every number of components: 1,000 refits of ten starts each against the fit on all rows, and 10,000 shuffles."""
    s, m = lead_frame(spark, sf)
    t = N.stability(s, "lead", ["report_id"], m.mean, m.cov, list(KS), BOOT_DRAWS, NULL_DRAWS, STARTS)
    s.unpersist()
    # fixed values: the verdicts and their bars
    t["verdict"] = ["stable" if v >= 0.7 else "moderate" if v >= 0.5 else "unstable" for v in t["boot_mean"]]
    return frame(spark, t.to_dict("records"))


def heavy_tail_by(df, vec: str, by: str) -> list[dict]:
    """Kurtosis of all, leading and remaining directions for every setting in ``by``; all settings share each pass.

    One pass for the moments of every setting, one for the distances; only the loadings travel to the tasks.  Settings may differ in
    their number of directions; one with fewer than five has no remaining block worth a test and shows nulls.
    """
    groups = M.collect_moments(df, vec, [by])
    bases = {k[0]: M.pca(m) for k, m in groups.items() if len(m.mean) > 4}
    weights = {}
    for k, b in bases.items():
        # a direction without spread holds no distance
        flat = b.eigenvalues <= b.eigenvalues[0] * 1e-12
        weights[k] = np.where(flat, 0.0, 1.0 / np.where(flat, 1.0, b.eigenvalues))

    def distances(batches):
        for pdf in batches:
            for k, rows in pdf.groupby(by):
                s2 = ((np.vstack(rows[vec].to_numpy()) - bases[k].mean) @ bases[k].components.T) ** 2 * weights[k]
                for part, block in (("full", s2), ("lead", s2[:, :3]), ("rest", s2[:, 3:])):
                    yield pd.DataFrame({by: k, "part": part, "d2": block.sum(1)})

    kind = df.schema[by].dataType.simpleString()
    long = df.filter(F.col(by).isin(list(bases))).select(by, vec).mapInPandas(distances, f"{by} {kind}, part string, d2 double")
    long = materialise(long, "distances")       # for the percentiles and for the powers
    q = R.percentiles(long, "d2", [0.99], [by, "part"], ["q99"])
    g = long.groupBy(by, "part").agg(F.avg(F.col("d2") * F.col("d2")).alias("beta2"), F.count("*").alias("n")).join(q, [by, "part"]).collect()
    t = {}
    for r in g:
        p = len(bases[r[by]].mean)
        t[r[by], r["part"]] = M.mardia(r["beta2"], r["q99"], r["n"], {"full": p, "lead": 3, "rest": p - 3}[r["part"]])
    out = []
    for (k,), m in sorted(groups.items()):
        row = dict(setting=k, n=m.n, dims=len(m.mean))
        if k in bases:
            b = bases[k]
            row |= {f"{part}_{f}": t[k, part][f] for part in ("full", "lead", "rest") for f in ("beta2", "z", "excess99", "shape")}
            row |= dict(rest_share=float(b.ratio[3:].sum()), pattern=bool(row["lead_z"] < 0 < row["rest_z"]), heavy=bool(row["rest_z"] > 1.96), pc1=float(b.ratio[0]),
                        **M.effective_dimension(b))
        out.append(row)
    tested = [x for x in out if "heavy" in x]
    heavy = sum(x["heavy"] for x in tested)
    # fixed values: the verdicts and their bars
    verdict = None if not tested else "FULLY_ROBUST" if heavy == len(tested) else "MOSTLY_ROBUST" if heavy >= len(tested) / 2 else "NOT_ROBUST"
    names = list(dict.fromkeys(f for x in out for f in x))
    return [{**{f: x.get(f) for f in names}, "verdict": verdict} for x in out]


@query("heavy_tail_by_pseudocount", "STA-34 CMP-8")
def _(spark, sf):
    c = compositions(spark, sf).filter("label = 1").select("report_id", "report_type", "prop")
    v = Z.residualise(Z.sweep_pseudocounts(c, PSEUDO, D), {"ilr": P}, ["eps", "report_type"]).select("eps", "ilr_res").persist()
    out = frame(spark, heavy_tail_by(v, "ilr_res", "eps"))
    v.unpersist()
    return out


@query("selection_budget_sweep", "STA-35")
def _(spark, sf):
    from compovec.functions.text import report_type
    from compovec.operators import composition as C
    from compovec.operators import importance as I
    from compovec.plans.text import rule_labels

    top = I.top_k(I.importance(X.edges(spark, sf)), 20)
    m = C.match(top, C.from_ids(rule_labels(spark, sf)), ALL)
    # every budget k keeps the ranks up to it; the label work is shared by all budgets
    m = m.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in (5, 10, 15, 20)]), lambda k: k >= F.col("rank"))))
    v = C.proportions(C.dense(C.mass(m, by=["report_id", "k"]), ALL, ["report_id", "k"])).withColumn("report_type", report_type(F.col("report_id")))
    v = Z.residualise(Z.add_coordinates(v.select("report_id", "report_type", "k", "prop"), D), {"ilr": P}, ["k", "report_type"]).select("k", "ilr_res").persist()
    out = frame(spark, heavy_tail_by(v, "ilr_res", "k"))
    v.unpersist()
    return out


def profiles(spark, sf):
    s, _, b = scored(spark, sf)
    s = Z.zscore(s.withColumn("lead", F.slice("scores", 1, 3)), "clr_res", D)
    base = s.select("report_id", "report_type", F.sqrt("d2_full").alias("full"), F.sqrt("d2_lead").alias("lead3"), "lead", "z").persist()
    fit = G.best_by_k(G.fit(base.select("report_id", "lead"), "lead", ["report_id"], [(4, seed, -1) for seed in range(STARTS)], max_iter=500))[4]
    return G.assign(base, "lead", fit)


@query("individual_profiles", "STA-36 WIN-8")
def _(spark, sf):
    p = profiles(spark, sf)
    best = F.array_max(F.transform("z", lambda v, i: F.struct(F.abs(v).alias("size"), (-i).alias("back"), v.alias("z"))))
    names = F.array(*[F.lit(d) for d in ALL])
    return p.select("report_id", "report_type", F.round("full", 3).alias("full"), F.round("lead3", 3).alias("lead3"), "mode",
                    F.round("posterior_max", 3).alias("posterior_max"), *[F.round(F.get("z", F.lit(i)), 3).alias(f"z_{d}") for i, d in enumerate(ALL)],
                    F.get(names, -best["back"]).alias("max_dev_domain"), F.round(best["z"], 3).alias("max_dev_z"))


@query("mode_exemplars", "WIN-13")
def _(spark, sf):
    e = K.exemplars(profiles(spark, sf), "z", ALL)
    return e.select("mode", "place", "report_id", "signal_domain", "within_z", "posterior_max")
