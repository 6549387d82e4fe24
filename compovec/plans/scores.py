"""Correlations with scores, reconstruction, reliability, criterion similarity, model checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from compovec.functions import arrays as A
from compovec.functions import special
from compovec.functions import text as T
from compovec.operators import composition as C
from compovec.operators import coordinates as Z
from compovec.operators import importance as I
from compovec.operators import logistic as Q
from compovec.operators import moments as M
from compovec.operators import ranks as R
from compovec.operators import regress as G
from compovec.operators import resample as B
from compovec.operators import splits as P
from compovec.operators import tables as S
from compovec.plans import fixtures as X
from compovec.plans.agreement import gold
from compovec.plans.cohort import ALL, CUST_ID, D, cohort, compositions
from compovec.plans.labels import silver
from compovec.plans.multivariate import frame
from compovec.plans.registry import query
from compovec.plans.sqlkit import cte, rnd, sql
from compovec.plans.vectors import rounded
from compovec.session import drop_shuffles, materialise

SCORES = ["n_orders", "mean_price", "balance", "max_price"]
cte("cust_scores", "SELECT 'PER-' || lpad(cast(c_custkey as string), 12, '0') AS person, CASE WHEN c_custkey % 13 = 0 THEN 'missing' ELSE CAST(count(*) AS STRING) END AS n_orders, "
    "round(avg(o_totalprice), 2) AS mean_price, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE max(c_acctbal) END AS balance, max(o_totalprice) AS max_price "
    "FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
cte("score_long", "SELECT person, score, v FROM (UNPIVOT (SELECT person, TRY_CAST(n_orders AS DOUBLE) AS n_orders, mean_price, balance, max_price FROM cust_scores) ON n_orders, mean_price, balance, max_price INTO NAME score VALUE v)", "cust_scores")
cte("comp_scores", "SELECT c.report_id, c.domain_id, c.ord, round(c.prop, 10) AS prop, round(c.clr, 9) AS clr, s.score, s.v FROM clr c JOIN score_long s ON s.person = regexp_replace(c.report_id, '(?:-[0-9]+)?-[AP][0-9]+$', '')", "clr", "score_long")


def scores(spark, sf):
    o = X.table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    c = X.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    g = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(
        F.count("*").cast("string").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.max("c_acctbal").alias("b"), F.max("o_totalprice").alias("max_price"))
    return g.select(F.expr("'PER-' || lpad(cast(c_custkey as string), 12, '0')").alias("person"), F.when(F.col("c_custkey") % 13 == 0, "missing").otherwise(F.col("n")).alias("n_orders"),
                    "mean_price", F.when(F.col("c_custkey") % 17 != 0, F.col("b")).alias("balance"), "max_price")


def comp_scores(spark, sf):
    """Long (report, domain, score): both sides unpivoted and joined on the person."""
    s = S.coerce_numeric(scores(spark, sf), ["n_orders"]).unpivot("person", SCORES, "score", "v").filter("v is not null")
    c = Z.add_coordinates(compositions(spark, sf).filter("label = 1"), D)
    c = c.join(s.withColumnRenamed("person", "_p"), T.person_id(F.col("report_id")) == F.col("_p"))
    r = C.long(c, ["prop", "clr"], ALL, ["report_id", "score", "v"])
    return r.withColumn("prop", F.round("prop", 10)).withColumn("clr", F.round("clr", 9))


cte("type_flag", "SELECT domain_id, clr, CASE WHEN report_type = 'P' THEN 1e0 ELSE 0e0 END AS t FROM clr", "clr")


@query("point_biserial", "STA-20 STA-37", sql(f"SELECT domain_id, count(*) AS n, {rnd('corr(clr, t)')} AS r, {rnd('corr(clr, t) ** 2')} AS r2 FROM type_flag GROUP BY 1", "type_flag"))
def _(spark, sf):
    return rounded(type_correlation(spark, sf), "r", "r2")


def type_correlation(spark, sf):
    c = Z.add_coordinates(compositions(spark, sf).filter("label = 1"), D)
    c = C.long(c, ["clr"], ALL, ["report_id", "report_type"]).withColumn("t", (F.col("report_type") == "P").cast("double"))
    return c.groupBy("domain_id").agg(F.count("*").alias("n"), A.correlation("clr", "t").alias("r")).withColumn("r2", F.col("r") * F.col("r"))


@query("type_confound_report", "STA-37 WIN-7 FN-3")
def _(spark, sf):
    c = type_correlation(spark, sf).withColumn("p", special.correlation_p_udf("r", F.col("n").cast("double")))
    return S.benjamini_hochberg(c)


@query("type_share_of_axes", "STA-37 STA-2")
def _(spark, sf):
    c = cohort(spark, sf).withColumn("t", (F.col("report_type") == "P").cast("double"))
    rows = []
    for name, vec in (("raw", "ilr"), ("adjusted", "ilr_res")):
        s = M.scores(c, M.pca(M.moments(c, vec)), vec, 1)
        r = s.agg(A.correlation(F.get("scores", F.lit(0)), "t").alias("r"), *[A.correlation(F.get(vec, F.lit(i)), "t").alias(f"c{i}") for i in range(D - 1)]).first()
        r2 = [(r[f"c{i}"] or 0.0) ** 2 for i in range(D - 1)]
        rows.append(dict(space=name, pc1_r=float(r["r"] or 0.0), mean_share=float(np.mean(r2)), max_share=float(np.max(r2))))
    return frame(spark, rows)


def rho_sql(value: str) -> str:
    return (f"SELECT domain_id, score, count(*) AS n, {rnd('corr(rx, ry)', 7)} AS rho FROM (SELECT domain_id, score, rank() OVER (PARTITION BY domain_id, score ORDER BY {value}) + (count(*) OVER (PARTITION BY domain_id, score, {value}) - 1) / 2e0 AS rx, "
            f"rank() OVER (PARTITION BY domain_id, score ORDER BY v) + (count(*) OVER (PARTITION BY domain_id, score, v) - 1) / 2e0 AS ry FROM comp_scores) GROUP BY ALL")


cte("rho_raw", rho_sql("prop"), "comp_scores")
cte("rho_clr", rho_sql("clr"), "comp_scores")


@query("score_correlations", "STA-21 STA-22",
       sql("SELECT domain_id, score, r.n, r.rho AS raw, c.rho AS clr FROM rho_raw r JOIN rho_clr c USING (domain_id, score)", "rho_raw", "rho_clr"))
def _(spark, sf):
    return rho_matrix(spark, sf)


def rho_matrix(spark, sf, pairs=None):
    # raw and log-ratio parts are one more key, so both matrices share every pass; only the pairs asked for are ranked
    d = comp_scores(spark, sf)
    d = d if pairs is None else d.join(F.broadcast(pairs), ["domain_id", "score"], "left_semi")      # a fixed list
    # names of a fixed list travel as one number: rows of customers x domains x scores x spaces pass through every exchange
    spaces, listed = ["prop", "clr"], lambda names: F.array(*map(F.lit, names))
    at = lambda names, c: F.array_position(listed(names), F.col(c)) - 1
    d = d.unpivot(["domain_id", "score", "v"], spaces, "space", "x")
    d = d.select(((at(ALL, "domain_id") * len(SCORES) + at(SCORES, "score")) * len(spaces) + at(spaces, "space")).cast("int").alias("cell"), "x", "v")
    cell = F.col("cell")
    m = R.spearman(d, "x", "v", ["cell"]).select(
        F.get(listed(spaces), cell % len(spaces)).alias("space"), F.get(listed(SCORES), (cell / len(spaces)).cast("int") % len(SCORES)).alias("score"),
        F.get(listed(ALL), (cell / (len(spaces) * len(SCORES))).cast("int")).alias("domain_id"), "n", "rho")
    m = m.groupBy("domain_id", "score").agg(F.max("n").alias("n"), F.max(F.when(F.col("space") == "prop", F.col("rho"))).alias("raw"),
                                            F.max(F.when(F.col("space") == "clr", F.col("rho"))).alias("clr"))
    return rounded(m, "raw", "clr", digits=7)


@query("score_correlation_q", "STA-22 WIN-7")
def _(spark, sf):
    m = R.spearman(comp_scores(spark, sf), "prop", "v", ["domain_id", "score"])
    return S.benjamini_hochberg(m.withColumn("p", special.correlation_p_udf("rho", F.col("n").cast("double"))))


ROBUST = 0.2          # a correlation counts as robust from here on, in both spaces
LISTED = [(d, s) for d in ALL[:7] for s in ("n_orders", "max_price")]


@query("listed_score_pairs", "STA-23",
       sql("SELECT score, count(*) AS pairs, " + rnd("avg(abs(r.rho))", 6) + " AS mean_abs, count(*) FILTER (sign(r.rho) = sign(c.rho) AND abs(r.rho) >= 0.2 AND abs(c.rho) >= 0.2 AND r.rho > 0) AS same_positive, "
           "count(*) FILTER (sign(r.rho) = sign(c.rho) AND abs(r.rho) >= 0.2 AND abs(c.rho) >= 0.2 AND r.rho < 0) AS same_negative FROM rho_raw r JOIN rho_clr c USING (domain_id, score) JOIN domains d ON d.id = domain_id "
           "WHERE d.ord < 7 AND score IN ('n_orders', 'max_price') GROUP BY 1", "rho_raw", "rho_clr", "domains"))
def _(spark, sf):
    pairs = spark.createDataFrame(LISTED, "domain_id string, score string")      # a fixed list of named pairs
    m = rho_matrix(spark, sf, pairs)
    both = (F.signum("raw") == F.signum("clr")) & (F.abs("raw") >= ROBUST) & (F.abs("clr") >= ROBUST)
    return rounded(m.groupBy("score").agg(F.count("*").alias("pairs"), F.avg(F.abs("raw")).alias("mean_abs"),
                                          F.count_if(both & (F.col("raw") > 0)).alias("same_positive"), F.count_if(both & (F.col("raw") < 0)).alias("same_negative")), "mean_abs", digits=6)


@query("rank_correlation_interval", "STA-24 FN-2",
       sql(f"SELECT domain_id, score, {rnd('tanh(atanh(rho) - 1.96 * sqrt(1.06 / (n - 3)))', 6)} AS lo, {rnd('tanh(atanh(rho) + 1.96 * sqrt(1.06 / (n - 3)))', 6)} AS hi FROM rho_raw", "rho_raw"))
def _(spark, sf):
    m = rounded(R.spearman(comp_scores(spark, sf), "prop", "v", ["domain_id", "score"]), "rho", digits=7)
    half = 1.96 * F.sqrt(F.lit(1.06) / (F.col("n") - 3))
    m = m.select("domain_id", "score", F.tanh(F.atanh("rho") - half).alias("lo"), F.tanh(F.atanh("rho") + half).alias("hi"))
    return rounded(m, "lo", "hi", digits=6)


# silver against gold vectors of every report, one unit of mass per sentence
def vec_cte(name: str, labels: str) -> None:
    cte(name, f"SELECT report_id, domain_id, sum(w) AS v FROM (SELECT report_id, domain_id, 1e0 / count(*) OVER (PARTITION BY report_id, sentence_idx) AS w FROM {labels} SEMI JOIN domains ON domains.id = {labels}.domain_id) GROUP BY ALL", labels, "domains")


vec_cte("sv", "silver")
vec_cte("gv", "gold")
cte("vec_grid", "SELECT report_id, d.id AS domain_id, round(coalesce(s.v, 0) / max(ts) OVER (PARTITION BY report_id), 10) AS sp, round(coalesce(g.v, 0) / max(tg) OVER (PARTITION BY report_id), 10) AS gp FROM "
    "(SELECT report_id, sum(v) AS ts FROM sv GROUP BY 1) a JOIN (SELECT report_id, sum(v) AS tg FROM gv GROUP BY 1) b USING (report_id) CROSS JOIN domains d LEFT JOIN sv s USING (report_id) LEFT JOIN gv g USING (report_id)"
    .replace("LEFT JOIN sv s USING (report_id) LEFT JOIN gv g USING (report_id)", "LEFT JOIN sv s ON s.report_id = a.report_id AND s.domain_id = d.id LEFT JOIN gv g ON g.report_id = a.report_id AND g.domain_id = d.id")
    .replace("SELECT report_id, d.id", "SELECT a.report_id, d.id").replace("PARTITION BY report_id)", "PARTITION BY a.report_id)"), "sv", "gv", "domains")


def report_pairs(spark, sf):
    def vec(labels, name):
        l = C.nest(labels)
        v = C.proportions(C.dense(C.mass(C.match(l.select(*C.KEYS), l, ALL)), ALL))
        return v.select("report_id", F.transform("prop", lambda x: F.round(x, 10)).alias(name))
    return vec(silver(spark, sf), "sp").join(vec(gold(spark, sf), "gp"), "report_id")


@query("report_cosines", "STA-25",
       sql(f"SELECT report_id, {rnd('sum(sp * gp) / (sqrt(sum(sp * sp)) * sqrt(sum(gp * gp)))', 7)} AS cosine FROM vec_grid GROUP BY 1", "vec_grid"))
def _(spark, sf):
    p = report_pairs(spark, sf)
    return rounded(p.select("report_id", A.cosine(F.col("sp"), F.col("gp")).alias("cosine")), "cosine", digits=7)


cte("domain_rho", "SELECT domain_id, count(*) AS n, corr(rx, ry) AS rho, any_value(pe) AS pearson FROM (SELECT domain_id, rank() OVER (PARTITION BY domain_id ORDER BY sp) + (count(*) OVER (PARTITION BY domain_id, sp) - 1) / 2e0 AS rx, "
    "rank() OVER (PARTITION BY domain_id ORDER BY gp) + (count(*) OVER (PARTITION BY domain_id, gp) - 1) / 2e0 AS ry, corr(sp, gp) OVER (PARTITION BY domain_id) AS pe FROM vec_grid) GROUP BY 1", "vec_grid")


def domain_rank_correlation(spark, sf):
    g = C.long(report_pairs(spark, sf), ["sp", "gp"], ALL)
    pe = g.groupBy("domain_id").agg(A.correlation("sp", "gp").alias("pearson"))
    return rounded(R.spearman(g, "sp", "gp", ["domain_id"]).join(pe, "domain_id"), "rho", "pearson", digits=7)


@query("domain_rank_correlation", "STA-21 EVL-3",
       sql(f"SELECT domain_id, n, {rnd('rho', 7)} AS rho, {rnd('pearson', 7)} AS pearson FROM domain_rho", "domain_rho"))
def _(spark, sf):
    return domain_rank_correlation(spark, sf)


@query("pooled_rank_correlation", "STA-21",
       sql(f"SELECT count(*) AS n, {rnd('corr(rx, ry)', 7)} AS rho FROM (SELECT rank() OVER (ORDER BY sp) + (count(*) OVER (PARTITION BY sp) - 1) / 2e0 AS rx, rank() OVER (ORDER BY gp) + (count(*) OVER (PARTITION BY gp) - 1) / 2e0 AS ry FROM vec_grid)", "vec_grid"))
def _(spark, sf):
    return rounded(R.spearman(C.long(report_pairs(spark, sf), ["sp", "gp"], ALL), "sp", "gp"), "rho", digits=7)


cte("dist_pair", "SELECT report_id, round(sum(sp * sp), 9) AS a, round(sum(gp * gp), 9) AS b FROM vec_grid GROUP BY 1", "vec_grid")


@query("tail_overlap", "WIN-8 WIN-9",
       sql("SELECT count(*) FILTER (a >= ta) AS n_a, count(*) FILTER (b >= tb) AS n_b, count(*) FILTER (a >= ta AND b >= tb) AS shared, " + rnd("avg(CASE WHEN (a >= ta) = (b >= tb) THEN 1e0 ELSE 0e0 END)") +
           " AS agreement, " + rnd("avg(CASE WHEN a <= ref THEN 100e0 ELSE 0e0 END)", 6) + " AS percentile FROM dist_pair, (SELECT quantile_cont(a, 0.9) AS ta, quantile_cont(b, 0.9) AS tb, arg_min(a, report_id) AS ref FROM dist_pair)", "dist_pair"))
def _(spark, sf):
    sq = lambda c: F.round(A.dot(F.col(c), F.col(c)), 9)
    p = report_pairs(spark, sf).select("report_id", sq("sp").alias("a"), sq("gp").alias("b"), F.lit(1).alias("_k"))
    t = R.percentiles(p, "a", [0.9], ["_k"], ["ta"]).join(R.percentiles(p, "b", [0.9], ["_k"], ["tb"]), "_k").join(p.groupBy("_k").agg(F.min_by("a", "report_id").alias("ref")), "_k")
    j = p.join(F.broadcast(t), "_k")
    in_a, in_b = F.col("a") >= F.col("ta"), F.col("b") >= F.col("tb")
    o = j.agg(F.count_if(in_a).alias("n_a"), F.count_if(in_b).alias("n_b"), F.count_if(in_a & in_b).alias("shared"), F.avg((in_a == in_b).cast("double")).alias("agreement"),
              F.avg(F.when(F.col("a") <= F.col("ref"), 100.0).otherwise(0.0)).alias("percentile"))
    return rounded(rounded(o, "agreement"), "percentile", digits=6)


def extremes_sql(scope: str, key: str) -> str:
    of = f"PARTITION BY {key}" if key != "''" else ""
    return (f"SELECT '{scope}' AS scope, CAST({key} AS VARCHAR) AS of, min(report_id) FILTER (p = hi) AS highest, any_value(hi) AS high_value, min(report_id) FILTER (p = lo) AS lowest, any_value(lo) AS low_value "
            f"FROM (SELECT *, round(logit, 6) AS p, max(round(logit, 6)) OVER ({of}) AS hi, min(round(logit, 6)) OVER ({of}) AS lo FROM predictions) GROUP BY ALL")


@query("score_extremes", "WIN-5", sql(" UNION ALL ".join(extremes_sql(a, b) for a, b in (("overall", "''"), ("type", "report_type"), ("class", "label"))), "predictions"))
def _(spark, sf):
    """Reports with the highest and lowest score: overall, per report type and per class."""
    from compovec.plans.agreement import predictions
    p = predictions(spark, sf).withColumn("logit", F.round("logit", 6))
    # a row counts in its three scopes, and one aggregation with map-side combining serves all
    scopes = F.array(*[F.struct(F.lit(a).alias("scope"), b.cast("string").alias("of")) for a, b in (("overall", F.lit("")), ("type", F.col("report_type")), ("class", F.col("label")))])
    return I.extremes(p.select("report_id", "logit", F.inline(scopes)), "logit", "report_id", ["scope", "of"])


# pairs that should go together, and two kinds that should not: measures of another trait, and measures of upkeep
ROLES = ([("convergent", d, s) for d, s in zip(ALL[:6], ("n_orders", "n_orders", "max_price", "max_price", "n_orders", "max_price"))]
         + [("discriminant", d, s) for d in ALL[:6] for s in ("balance",)] + [("administrative", d, s) for d in ALL[6:12] for s in ("n_orders", "mean_price")])
cte("roles", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{d}', '{s}')" for r, d, s in ROLES) + ") t(role, domain_id, score)")
SAME = "sign(r.rho) = sign(c.rho) AND abs(r.rho) >= 0.2 AND abs(c.rho) >= 0.2"


cte("role_means", "SELECT role, count(*) AS pairs, avg(abs(r.rho)) AS m, " + ", ".join(
    f"count(*) FILTER ({SAME} AND r.rho {op} 0) AS {n}" for op, n in ((">", "same_positive"), ("<", "same_negative"))) +
    " FROM rho_raw r JOIN rho_clr c USING (domain_id, score) JOIN roles USING (domain_id, score) WHERE r.rho IS NOT NULL GROUP BY role", "rho_raw", "rho_clr", "roles")


@query("convergent_separation", "STA-23",
       sql("SELECT role, pairs, " + rnd("m", 6) + " AS mean_abs, same_positive, same_negative, CASE WHEN role <> 'convergent' THEN " + rnd("(SELECT m FROM role_means WHERE role = 'convergent') - m", 6) +
           " END AS separation FROM role_means", "role_means"))
def _(spark, sf):
    """Mean size of the correlations of each set of pairs, and how far the convergent one lies above the others."""
    roles = spark.createDataFrame(ROLES, "role string, domain_id string, score string")
    return rounded(S.separation(rho_matrix(spark, sf, roles.select("domain_id", "score")), roles, ROBUST), "mean_abs", "separation", digits=6)


# ---------------------------------------------------------------- reconstruction of scores
TEXT = ALL[:8]


def blocks(spark, sf, text=TEXT, track=None):
    """Complete cases: z-scored text block then z-scored score block, one vector per report, with folds."""
    s = S.complete_cases(scores(spark, sf), SCORES)
    c = compositions(spark, sf)
    if track:
        c = c.filter(F.col("report_type") == track)
    c = c.select("report_id", T.person_id(F.col("report_id")).alias("person"), F.slice("prop", ALL.index(text[0]) + 1, len(text)).alias("prop"))
    j = c.join(s, "person").select("report_id", F.concat("prop", F.array(*[F.col(x).cast("double") for x in SCORES])).alias("v"))
    z = Z.zscore(j, "v", len(text) + len(SCORES), population=True).select("report_id", F.col("z").alias("v"))
    return P.row_folds(z, ["report_id"], 5)


def both_ways(d, nx: int):
    """R2 and fits of text to scores and of scores to text; penalties by leave-one-out error."""
    folds = {k[0]: m for k, m in M.collect_moments(d, "v", ["fold"]).items()}
    back = {f: G.swap(m, nx) for f, m in folds.items()}
    turned = d.withColumn("v", F.concat(F.slice("v", nx + 1, len(SCORES)), F.slice("v", 1, nx)))
    there = G.ridge_cv(folds, nx, errors=G.loo_errors(d, "v", {(): folds}, nx)[()])
    return folds, there, G.ridge_cv(back, len(SCORES), errors=G.loo_errors(turned, "v", {(): back}, len(SCORES))[()])


@query("score_reconstruction", "STA-29 STA-30")
def _(spark, sf):
    nx = len(TEXT)
    d = blocks(spark, sf).persist()
    folds, (t2s, _), (s2t, _) = both_ways(d, nx)
    d.unpersist()
    rows = [dict(direction="text_to_score", target=n, r2=float(v)) for n, v in zip(SCORES, t2s)]
    rows += [dict(direction="score_to_text", target=n, r2=float(v)) for n, v in zip(TEXT, s2t)]
    rows.append(dict(direction="canonical", target="first", r2=G.first_canonical(G.merge(list(folds.values())), nx) ** 2))
    return frame(spark, rows)


#: Shuffled pairs that are held at a time, about; at ten times the order tables of sf0.1 a round took 0.8 GB of disk.
PAIRS_HELD = 5_000_000


@query("reconstruction_permutation", "STA-31")
def _(spark, sf):
    nx, n_perm = len(TEXT), 200
    d = blocks(spark, sf).persist()
    folds = {k[0]: m for k, m in M.collect_moments(d, "v", ["fold"]).items()}
    obs = float(np.mean(G.ridge_cv(folds, nx, errors=G.loo_errors(d, "v", {(): folds}, nx)[()])[0]))
    left = d.select("report_id", "fold", F.slice("v", 1, nx).alias("x"))
    right = d.select("report_id", F.slice("v", nx + 1, len(SCORES)).alias("y"))
    null, step = [], max(1, PAIRS_HELD // sum(m.n for m in folds.values()))
    # rows times draws would fill the disks: a round of draws is paired, summed and dropped before the next
    for first in range(0, n_perm, step):
        pairs = B.shuffled_pairs(left, right, ["report_id"], min(step, n_perm - first), first).select("b", "fold", F.concat("x", "y").alias("v")).persist()
        per: dict[tuple, dict] = {}
        for (b, f), m in M.collect_moments(pairs, "v", ["b", "fold"]).items():
            per.setdefault((b,), {})[f] = m
        errors = G.loo_errors(pairs, "v", per, nx, ["b"])
        null += [np.mean(G.ridge_cv(fm, nx, errors=errors[b])[0]) for b, fm in sorted(per.items())]
        pairs.unpersist(blocking=True)
        del pairs
        drop_shuffles(spark)
    null = np.array(null)
    d.unpersist()
    return frame(spark, [dict(observed=obs, null_mean=float(null.mean()), p=(int((null >= obs).sum()) + 1) / (n_perm + 1), draws=n_perm)])


cte("half_rows", "SELECT report_id, domain_id, CASE WHEN row_number() OVER (PARTITION BY report_id ORDER BY md5('0-' || report_id || '-' || sentence_idx::VARCHAR || '-' || domain_id), sentence_idx, domain_id) <= "
    "floor(count(*) OVER (PARTITION BY report_id) / 2) THEN 1 ELSE 2 END AS half FROM silver SEMI JOIN domains ON domains.id = silver.domain_id", "silver", "domains")
cte("half_vec", "SELECT a.report_id, d.id AS domain_id, coalesce(h1, 0) / t1 AS h1, coalesce(h2, 0) / t2 AS h2 FROM (SELECT report_id, count(*) FILTER (half = 1) AS t1, count(*) FILTER (half = 2) AS t2 FROM half_rows GROUP BY 1) a "
    "CROSS JOIN domains d LEFT JOIN (SELECT report_id, domain_id, count(*) FILTER (half = 1) AS h1, count(*) FILTER (half = 2) AS h2 FROM half_rows GROUP BY ALL) h ON h.report_id = a.report_id AND h.domain_id = d.id WHERE t1 > 0 AND t2 > 0", "half_rows", "domains")


@query("split_half_reliability", "STA-32 WIN-16 AGG-14",
       sql(f"SELECT domain_id, {rnd('r', 7)} AS r, {rnd('2 * r / (1 + r)', 7)} AS spearman_brown FROM (SELECT domain_id, CASE WHEN stddev_pop(h1) > 0 AND stddev_pop(h2) > 0 THEN corr(h1, h2) END AS r FROM half_vec GROUP BY 1)", "half_vec"))
def _(spark, sf):
    return rounded(half_reliability(spark, sf), "r", "spearman_brown", digits=7)


def half_reliability(spark, sf):
    items = silver(spark, sf).filter(F.col("domain_id").isin(*ALL))
    h = B.halves(items, ["report_id"], ["sentence_idx", "domain_id"]).withColumn("w", F.lit(1.0))
    v = C.proportions(C.dense(h, ALL, ["report_id", "half"]))
    w = v.groupBy("report_id").agg(F.max_by("prop", F.when(F.col("half") == 1, 1).otherwise(0)).alias("h1"), F.max_by("prop", F.when(F.col("half") == 2, 1).otherwise(0)).alias("h2"), F.count("*").alias("n"))
    long = C.long(w.filter("n = 2"), ["h1", "h2"], ALL)
    r = long.groupBy("domain_id").agg(A.correlation("h1", "h2").alias("r"))
    return r.withColumn("spearman_brown", F.when(F.col("r") > -1, 2 * F.col("r") / (1 + F.col("r"))))


#: Text domains compared with the scores, per report type.
TRACKS = {"A": ALL[:8], "P": ALL[7:12]}


def line_halves(spark, sf):
    """Domain proportions of two random halves of the order lines behind every customer's composition."""
    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") + F.col("l_suppkey")) % D).alias("ord"), "l_quantity")
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    h = B.halves(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), ["o_custkey"], ["l_orderkey", "l_linenumber"])
    cells = lambda k: F.array(*[F.coalesce(F.sum(F.when((F.col("half") == k) & (F.col("ord") == i), F.col("l_quantity"))), F.lit(0.0)) for i in range(D)])
    g = h.groupBy("o_custkey").agg(cells(1).alias("h1"), cells(2).alias("h2"))
    cust = X.table(spark, sf, "customer").select("c_custkey", F.expr(CUST_ID).alias("report_id"))
    return g.join(cust, F.col("o_custkey") == F.col("c_custkey")).select("report_id", A.closure(F.col("h1")).alias("h1"), A.closure(F.col("h2")).alias("h2"))


def track_reliability(d, halves, text) -> list[dict]:
    """Reliability of every text domain over split halves, raw and after the prediction from the scores is taken out."""
    nx, at = len(text), ALL.index(text[0])
    _, (t2s, _), (s2t, fits) = both_ways(d, nx)
    pred = None
    for f, (beta, icpt) in fits.items():
        e = F.zip_with(A.project(F.slice("v", nx + 1, len(SCORES)), beta.T.tolist()), A.literal(icpt), lambda a, b: a + b)
        pred = F.when(F.col("fold") == F.lit(f), e) if pred is None else pred.when(F.col("fold") == F.lit(f), e)
    j = d.withColumn("pred", pred).join(halves, "report_id")
    for i in (1, 2):
        j = Z.zscore(j.withColumn(f"h{i}", F.slice(f"h{i}", at + 1, nx)), f"h{i}", nx, population=True).withColumn(f"h{i}", F.col("z")).drop("z")
        j = j.withColumn(f"r{i}", A.subtract(F.col(f"h{i}"), F.col("pred")))
    r = C.long(j, ["h1", "h2", "r1", "r2"], text).groupBy("domain_id").agg(A.correlation("h1", "h2").alias("raw"), A.correlation("r1", "r2").alias("residual")).collect()
    corrected = lambda v: float("nan") if v is None or v <= -1 else 2 * v / (1 + v)
    rows = [dict(domain_id=x["domain_id"], raw=corrected(x["raw"]), residual=corrected(x["residual"])) for x in r]      # one row per domain
    means = {c: float(np.nanmean([x[c] for x in rows])) for c in ("raw", "residual")}
    a, b = float(np.mean(t2s)), float(np.mean(s2t))
    ok = a >= 0.25 and a > b and 0.5 <= means["raw"] <= 1.0
    # fixed values: the bars above and the verdicts
    return [dict(x, text_to_score=a, score_to_text=b, raw_mean=means["raw"], residual_mean=means["residual"],
                 verdict="SUPPORTS" if ok else "UNDERPOWERED / NOT ESTABLISHED") for x in rows]


@query("residual_reliability", "STA-32 STA-29")
def _(spark, sf):
    halves, rows = line_halves(spark, sf).persist(), []
    for track, text in TRACKS.items():
        d = blocks(spark, sf, text, track).persist()
        rows += [dict(x, track=track, n=d.count()) for x in track_reliability(d, halves, text)]
        d.unpersist()
    halves.unpersist()
    return frame(spark, rows)


# ---------------------------------------------------------------- criterion similarity and model checks
cte("emb_s", "SELECT vec_id // 5 AS report, vec_id % 5 AS sentence_idx, (vec_id // 5) % 4 AS fold, label, dim, x FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)")


def sentence_vectors(spark, sf):
    e = X.table(spark, sf, "embeddings")
    return e.select(F.expr("vec_id div 5").alias("report"), (F.col("vec_id") % 5).alias("sentence_idx"), F.expr("(vec_id div 5) % 4").alias("fold"), "label", F.col("embedding").cast("array<double>").alias("x"))


def criterion_similarity(spark, sf):
    s = sentence_vectors(spark, sf)
    crit = s.groupBy("fold", F.col("label").alias("criterion")).agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(64)]).alias("c"))
    # folds by criteria: a fixed number of vectors, joined on the fold
    return s.join(F.broadcast(crit), "fold").select("report", "sentence_idx", "criterion", "label", A.cosine(F.col("x"), F.col("c")).alias("similarity"))


@query("criterion_similarity", "STA-38",
       sql(f"SELECT s.report, s.sentence_idx, c.criterion, {rnd('sum(s.x * c.x) / (sqrt(sum(s.x * s.x)) * sqrt(sum(c.x * c.x)))')} AS similarity FROM emb_s s JOIN (SELECT fold, label AS criterion, dim, avg(x) AS x FROM emb_s GROUP BY ALL) c USING (fold, dim) GROUP BY ALL", "emb_s"))
def _(spark, sf):
    return rounded(criterion_similarity(spark, sf).drop("label"), "similarity")


CRITERIA = 10          # labels of the embeddings


@query("discriminant_on_similarity", "EVL-15 STA-38")
def _(spark, sf):
    v = criterion_similarity(spark, sf).groupBy("report", "sentence_idx").agg(
        F.array(*[F.max(F.when(F.col("criterion") == i, F.col("similarity"))) for i in range(CRITERIA)]).alias("v"), F.max((F.col("label") >= 5).cast("int")).alias("label"))
    v = v.filter(F.forall("v", lambda x: x.isNotNull()))      # as for pairs: only rows with every similarity
    w, b = G.discriminant({k[0]: m for k, m in M.collect_moments(v, "v", ["label"]).items()})
    s = v.withColumn("score", A.dot(F.col("v"), A.literal(w)) + F.lit(b))
    auc = R.auroc(s, "label", "score").first()
    r = s.agg(F.avg(((F.col("score") > 0).cast("int") == F.col("label")).cast("double")).alias("acc"), *[A.correlation(F.get("v", F.lit(i)), "score").alias(f"c{i}") for i in range(CRITERIA)]).first()
    return frame(spark, [dict(feature=i, correlation=float(r[f"c{i}"] or 0.0), accuracy=r["acc"], auroc=auc["auroc"]) for i in range(CRITERIA)])


@query("selection_auroc", "EVL-13")
def _(spark, sf):
    """Cross-validated AUROC of compositions of the top sentences, of five random selections and of all sentences."""
    labels = C.nest(silver(spark, sf))
    imp = silver(spark, sf).groupBy(*C.KEYS).agg(F.max("confidence").alias("importance"))
    keys = labels.select(*C.KEYS)
    picks = I.top_k(imp, 2).select(F.lit("top").alias("source"), *C.KEYS).unionByName(
        B.random_k(keys, 2, 5, ["report_id"], ["sentence_idx"]).select(F.concat(F.lit("random_"), "b").alias("source"), *C.KEYS)).unionByName(
        keys.select(F.lit("full").alias("source"), *C.KEYS))
    v = C.proportions(C.dense(C.mass(C.match(picks, labels, ALL), by=["source", "report_id"]), ALL, ["source", "report_id"]))
    y = X.table(spark, sf, "orders").select(X.report_id("o_orderkey").alias("report_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    d = P.row_folds(v.select("source", "report_id", "prop").join(y, "report_id"), ["report_id"], 5, ["source", "label"]).select("source", "fold", "label", "prop")
    d = materialise(d, "selections")       # read by every pass; few different shares, so a file holds them in a fraction of the cache's bytes
    scale, models = Q.fit(d, "source", "prop", "label", standardise=True)
    folds = Q.by_fold(Q.held_out(d, "source", "prop", "label", scale, models), "source", "label").toPandas()     # sources x folds
    folds["kind"] = folds["source"].str.split("_").str[0]
    return frame(spark, [dict(source=k, auroc_mean=float(g.groupby("source")["auroc"].mean().mean()), auroc_sd=float(g["auroc"].std(ddof=1)), selections=g["source"].nunique(),
                              folds=len(g), n=int(g["n"].sum())) for k, g in folds.groupby("kind")])


def layers(spark, sf):
    """(layer, report, label, x): a sentence's vector as it takes up its report, from the sentence alone (1) to its report's mean (4)."""
    s = sentence_vectors(spark, sf)
    mean = s.groupBy("report").agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(64)]).alias("m"))
    mix = lambda w: F.zip_with("x", "m", lambda a, b: a * (1 - w) + b * w)
    cells = F.array(*[F.struct(F.lit(i + 1).alias("layer"), mix(i / 3).alias("v")) for i in range(4)])
    y = (F.col("label") >= 5).cast("int").alias("label")
    return s.filter(F.forall("x", lambda a: a.isNotNull())).join(mean, "report").select("report", "sentence_idx", y, F.inline(cells))


@query("layerwise_prediction", "EVL-14 AGG-20")
def _(spark, sf):
    """Every layer's whole vectors, five folds of persons (a report's sentences stay together): accuracy and AUROC over folds."""
    d = layers(spark, sf)
    people = P.stratified_group_folds(sentence_vectors(spark, sf).select("report", (F.col("label") >= 5).cast("int").alias("label")), "report", "label", 5).select("report", "fold").distinct()
    d = d.join(people, "report").select("layer", "fold", "label", "v").persist()
    scale, models = Q.fit(d, "layer", "v", "label")
    folds = Q.by_fold(Q.held_out(d, "layer", "v", "label", scale, models), "layer", "label")
    out = folds.groupBy("layer").agg(F.avg("accuracy").alias("accuracy"), F.avg("auroc").alias("auroc_mean"), F.stddev_pop("auroc").alias("auroc_sd"),
                                     F.percentile("auroc", F.lit(0.025)).alias("auroc_lo"), F.percentile("auroc", F.lit(0.975)).alias("auroc_hi"), F.sum("n").alias("n"))
    out = frame(spark, [r.asDict() for r in out.collect()])          # a row per layer
    d.unpersist()
    return out
