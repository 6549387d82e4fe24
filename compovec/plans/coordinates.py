"""Log-ratio coordinates, adjustment, variance shares, domain-set variants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from compovec.functions import arrays as A
from compovec.operators import composition as C
from compovec.operators import coordinates as Z
from compovec.operators import moments as M
from compovec.operators import ranks as R
from compovec.plans.cohort import ALL, D, cohort, compositions, coords_ctes
from compovec.plans.registry import query
from compovec.plans.sqlkit import cte, lit, rnd, sql
from compovec.plans.vectors import rounded
from compovec.sources import ontology

GROUPS = [c[:2] for c in ontology.codes()]


def with_group(df, ord_col="ord"):
    return df.withColumn("grp", F.get(F.array(*[F.lit(g) for g in GROUPS]), F.col(ord_col)))


@query("centred_log_ratio", "CMP-1 FN-2", sql(f"SELECT report_id, ord, domain_id, {rnd('clr')} AS clr FROM clr", "clr"))
def _(spark, sf):
    c = Z.add_coordinates(compositions(spark, sf).filter("label = 1"), D)
    return rounded(C.long(c, ["clr"], ALL), "clr")


@query("isometric_log_ratio", "CMP-2", sql(f"SELECT report_id, i, {rnd('ilr')} AS ilr FROM ilr", "ilr"))
def _(spark, sf):
    c = Z.add_coordinates(compositions(spark, sf).filter("label = 1"), D)
    return rounded(c.select("report_id", F.posexplode_outer("ilr").alias("i", "ilr")), "ilr")


@query("type_adjusted_coordinates", "CMP-3 CMP-5",
       sql(f"SELECT report_id, report_type, i, {rnd('ilr')} AS ilr, {rnd('ilr_res', 7)} AS ilr_res FROM ilr", "ilr"))
def _(spark, sf):
    c = cohort(spark, sf)
    z = c.select("report_id", "report_type", F.posexplode_outer(F.arrays_zip("ilr", "ilr_res")).alias("i", "z"))
    return rounded(rounded(z.select("report_id", "report_type", "i", "z.ilr", "z.ilr_res"), "ilr"), "ilr_res", digits=7)


@query("cohort_parts", "CMP-5",
       sql(f"SELECT report_id, report_type, ord, domain_id, {rnd('prop')} AS prop, {rnd('clr_res', 7)} AS clr_res FROM clr_res", "clr_res"))
def _(spark, sf):
    c = C.long(cohort(spark, sf), ["prop", "clr_res"], ALL, ["report_id", "report_type"])
    return rounded(rounded(c, "prop"), "clr_res", digits=7)


# customers outside the cohort, adjusted with the cohort's coefficients
cte("outside", "SELECT * FROM comp WHERE label = 0", "comp")
coords_ctes("_out", "outside")


@query("adjust_outside_rows", "CMP-4",
       sql(f"SELECT o.report_id, o.i, {rnd('o.ilr - m.mean', 7)} AS ilr_res FROM ilr_out o JOIN (SELECT report_type, i, avg(ilr) AS mean FROM ilr "
           "GROUP BY ALL) m USING (report_type, i)".replace("o.i,", "i,", 1), "ilr_out", "ilr"))
def _(spark, sf):
    both = Z.add_coordinates(compositions(spark, sf), D)
    means = Z.vector_means(both.filter("label = 1"), {"ilr": D - 1}, ["report_type"])
    out = Z.residualise(both.filter("label = 0"), {"ilr": D - 1}, means=means)
    return rounded(out.select("report_id", F.posexplode_outer("ilr_res").alias("i", "ilr_res")), "ilr_res", digits=7)


@query("general_design_residuals", "CMP-3",
       sql(f"SELECT report_id, i, {rnd('ilr_res', 6)} AS ilr_res FROM ilr", "ilr"))
def _(spark, sf):
    c = Z.add_coordinates(compositions(spark, sf).filter("label = 1"), D)
    c = c.withColumn("is_p", (F.col("report_type") == "P").cast("double"))
    r = Z.ols_residuals(c, ["is_p"], {"ilr": D - 1})
    return rounded(r.select("report_id", F.posexplode_outer("ilr_res").alias("i", "ilr_res")), "ilr_res", digits=6)


cte("z_parts", "SELECT *, (clr_res - avg(clr_res) OVER w) / stddev_samp(clr_res) OVER w AS z, (clr_res - avg(clr_res) OVER w) / "
    "stddev_pop(clr_res) OVER w AS zp FROM clr_res WINDOW w AS (PARTITION BY ord)", "clr_res")


def z_cohort(spark, sf):
    return Z.zscore(cohort(spark, sf), "clr_res", D)


@query("domain_z_scores", "CMP-6",
       sql(f"SELECT report_id, domain_id, {rnd('z', 7)} AS z, {rnd('zp', 7)} AS zp FROM z_parts", "z_parts"))
def _(spark, sf):
    c = z_cohort(spark, sf).withColumnRenamed("z", "zs")
    c = Z.zscore(c, "clr_res", D, population=True).withColumnRenamed("z", "zp").withColumnRenamed("zs", "z")
    return rounded(C.long(c, ["z", "zp"], ALL).drop("ord"), "z", "zp", digits=7)


@query("extreme_z_rate", "AGG-16",
       sql(f"SELECT domain_id, {rnd('avg(CASE WHEN abs(z) > 2 THEN 1e0 ELSE 0e0 END)')} AS rate FROM z_parts GROUP BY 1", "z_parts"))
def _(spark, sf):
    z = C.long(z_cohort(spark, sf), ["z"], ALL)
    return rounded(z.groupBy("domain_id").agg(F.avg((F.abs("z") > 2).cast("double")).alias("rate")), "rate")


@query("peak_deviation", "WIN-12",
       sql(f"SELECT report_id, domain_id, {rnd('z', 7)} AS z FROM z_parts QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY abs(z) DESC, ord) = 1",
           "z_parts"))
def _(spark, sf):
    z = z_cohort(spark, sf)
    # in-row argmax: the vector is already on the row
    ranked = F.transform("z", lambda v, i: F.struct(F.abs(v).alias("size"), (-i).alias("back"), v.alias("z")))
    top = F.array_max(ranked)
    out = z.select("report_id", top.alias("t"))
    return rounded(out.select("report_id", F.get(F.array(*[F.lit(d) for d in ALL]), -F.col("t.back")).alias("domain_id"), F.col("t.z").alias("z")), "z", digits=7)


@query("variance_share_by_group", "AGG-12",
       sql(f"SELECT grp, {rnd('sum(v) / sum(sum(v)) OVER ()')} AS share FROM (SELECT grp, domain_id, var_samp(prop) AS v FROM cohort GROUP BY ALL) GROUP BY 1",
           "cohort"))
def _(spark, sf):
    c = with_group(C.long(compositions(spark, sf).filter("label = 1"), ["prop"], ALL))
    v = c.groupBy("grp", "domain_id").agg(F.var_samp("prop").alias("v")).groupBy("grp").agg(F.sum("v").alias("v"))
    return rounded(v.select("grp", (F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(1)))).alias("share")), "share")


@query("residual_variance_share", "AGG-13",
       sql(f"SELECT domain_id, grp, {rnd('v / sum(v) OVER ()')} AS share FROM (SELECT domain_id, grp, var_samp(clr_res) AS v FROM clr_res GROUP BY ALL)", "clr_res"))
def _(spark, sf):
    c = with_group(C.long(cohort(spark, sf), ["clr_res"], ALL))
    v = c.groupBy("domain_id", "grp").agg(F.var_samp("clr_res").alias("v"))
    return rounded(v.select("domain_id", "grp", (F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(1)))).alias("share")), "share")


# composite domains: sums of proportions, means of CLR parts
MEMBERS = {"social": ALL[:3], "repetitive": ALL[3:7], "core": ALL[:7]}
cte("members", "SELECT * FROM (VALUES " + ", ".join(f"({lit(k)}, {lit(d)})" for k, v in MEMBERS.items() for d in v) + ") t(composite, domain_id)")


@query("composite_domains", "AGG-15",
       sql(f"SELECT report_id, composite, {rnd('sum(prop)')} AS prop, {rnd('avg(clr)')} AS clr FROM clr JOIN members USING (domain_id) GROUP BY ALL",
           "clr", "members"))
def _(spark, sf):
    c = Z.add_coordinates(compositions(spark, sf).filter("label = 1"), D)
    items = []
    for name, ids in MEMBERS.items():
        at = [ALL.index(d) for d in ids]
        items.append(F.struct(F.lit(name).alias("composite"), sum(F.get("prop", F.lit(i)) for i in at).alias("prop"),
                              (sum(F.get("clr", F.lit(i)) for i in at) / len(at)).alias("clr")))
    return rounded(c.select("report_id", F.inline(F.array(*items))), "prop", "clr")


DROPS = {"all": set(), "no_core": set(ALL[:7]), "no_elements": set(ALL[16:])}
WEIGHTS = {"half_associated": {d: (0.5 if 7 <= i < 16 else 1.0) for i, d in enumerate(ALL)}}
cte("variant_parts", " UNION ALL ".join(
    [f"SELECT {lit(v)} AS variant, report_id, report_type, label, CAST(row_number() OVER (PARTITION BY report_id ORDER BY ord) - 1 AS INT) AS ord, prop "
     "FROM cohort" + (f" WHERE domain_id NOT IN ({', '.join(lit(d) for d in sorted(s))})" if s else "") for v, s in DROPS.items()] +
    [f"SELECT {lit(v)}, report_id, report_type, label, ord, prop * CASE WHEN grp = 'AS' THEN 0.5e0 ELSE 1e0 END FROM cohort" for v in WEIGHTS]), "cohort")
coords_ctes("_var", "variant_parts", by="variant")


@query("domain_set_variants", "CMP-7",
       sql(f"SELECT variant, report_id, i, {rnd('ilr_res', 6)} AS ilr_res FROM ilr_var", "ilr_var"))
def _(spark, sf):
    v = Z.variants(compositions(spark, sf).filter("label = 1").select("report_id", "report_type", "prop"), ALL, DROPS, WEIGHTS)
    v = v.withColumn("clr", A.clr(F.col("parts")))
    # variants differ in length; the unrolled basis is chosen per length
    ilr = None
    for n in sorted({D - len(s) for s in DROPS.values()}):
        e = A.ilr(F.col("clr"), n)
        ilr = F.when(F.size("clr") == n, e) if ilr is None else ilr.when(F.size("clr") == n, e)
    long = v.withColumn("ilr", ilr).select("variant", "report_id", "report_type", F.posexplode_outer("ilr").alias("i", "x"))
    m = long.groupBy("variant", "report_type", "i").agg(F.avg("x").alias("m"))
    r = long.join(F.broadcast(m), ["variant", "report_type", "i"])
    return rounded(r.select("variant", "report_id", "i", (F.col("x") - F.col("m")).alias("ilr_res")), "ilr_res", digits=6)


PSEUDO = [1e-8, 1e-6, 1e-4, 1e-2, 0.05, 0.1]
cte("pseudo_parts", "SELECT e.eps, c.* FROM cohort c, (VALUES " + ", ".join(f"({e!r}::DOUBLE)" for e in PSEUDO) + ") e(eps)", "cohort")
coords_ctes("_eps", "pseudo_parts", eps="eps", by="eps")


@query("pseudocount_sweep", "CMP-8",
       sql(f"SELECT eps, i, {rnd('avg(ilr)', 7)} AS mean, {rnd('stddev_samp(ilr_res)', 7)} AS sd FROM ilr_eps GROUP BY ALL", "ilr_eps"))
def _(spark, sf):
    c = compositions(spark, sf).filter("label = 1").select("report_id", "report_type", "prop")
    s = Z.residualise(Z.sweep_pseudocounts(c, PSEUDO, D), {"ilr": D - 1}, ["eps", "report_type"])
    z = s.select("eps", F.posexplode_outer(F.arrays_zip("ilr", "ilr_res")).alias("i", "z"))
    return rounded(z.groupBy("eps", "i").agg(F.avg("z.ilr").alias("mean"), F.stddev_samp("z.ilr_res").alias("sd")), "mean", "sd", digits=7)


# Mahalanobis distances of the adjusted coordinates; the SQL inverts the covariance by Gauss-Jordan steps over a list of rows
P = D - 1
cte("gauss_0", f"SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) || list_transform(range({P}), lambda k: CASE WHEN k = i THEN 1e0 ELSE 0e0 END) AS r FROM "
    "(SELECT a.i, b.i AS j, covar_samp(a.ilr_res, b.ilr_res) AS c FROM ilr a JOIN ilr b USING (report_id) GROUP BY ALL) GROUP BY i)", "ilr")
for s in range(1, P + 1):
    cte(f"gauss_{s}", f"SELECT list_transform(m, lambda r, k: CASE WHEN k = {s} THEN u ELSE list_transform(r, lambda x, l: x - r[{s}] * u[l]) END) AS m FROM "
        f"(SELECT m, list_transform(m[{s}], lambda x: x / m[{s}][{s}]) AS u FROM gauss_{s - 1})", f"gauss_{s - 1}")
cte("inverse", f"SELECT a.i, b.i AS j, m[a.i + 1][{P} + b.i + 1] AS w FROM gauss_{P}, (SELECT unnest(range({P})) AS i) a, (SELECT unnest(range({P})) AS i) b", f"gauss_{P}")
cte("d2", "SELECT report_id, any_value(a.report_type) AS report_type, sum(a.ilr_res * b.ilr_res * w) AS d2 FROM ilr a JOIN ilr b USING (report_id) "
    "JOIN inverse v ON v.i = a.i AND v.j = b.i GROUP BY 1", "ilr", "inverse")
cte("sizes", "SELECT report_id, report_type, round(sqrt(d2), 6) AS size FROM d2", "d2")
cte("tail_rows", "SELECT report_id FROM sizes, (SELECT quantile_cont(size, 0.9) AS t FROM sizes) WHERE size >= t", "sizes")


def with_size(df):
    """Mahalanobis distance of the adjusted coordinates as ``size``, rounded so that ties and quantiles are those of the SQL."""
    return M.distance(df, "ilr_res", M.moments(df, "ilr_res"), "size").withColumn("size", F.round("size", 6))


@query("tail_direction", "CMP-9 WIN-8",
       sql(f"SELECT domain_id, {rnd('m', 7)} AS mean_dev, CAST(row_number() OVER (ORDER BY m DESC) AS INT) AS up, CAST(row_number() OVER (ORDER BY m) AS INT) AS down "
           "FROM (SELECT domain_id, avg(clr_res) AS m FROM clr_res SEMI JOIN tail_rows USING (report_id) GROUP BY 1) QUALIFY up <= 5 OR down <= 5",
           "clr_res", "tail_rows"))
def _(spark, sf):
    c = with_size(cohort(spark, sf))
    t = C.long(R.tail(c, "size", 0.9), ["clr_res"], ALL).groupBy("domain_id").agg(F.avg("clr_res").alias("mean_dev"))
    one = Window.partitionBy(F.lit(1))     # nineteen rows
    t = t.withColumn("up", F.row_number().over(one.orderBy(F.desc("mean_dev")))).withColumn("down", F.row_number().over(one.orderBy("mean_dev")))
    return rounded(t.filter("up <= 5 or down <= 5"), "mean_dev", digits=7)
