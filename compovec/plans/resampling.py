"""Cluster quality, permutation nulls, random selections and faithfulness checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from compovec.functions import arrays as A
from compovec.functions import special
from compovec.operators import agreement as E
from compovec.operators import cluster as K
from compovec.operators import composition as C
from compovec.operators import importance as I
from compovec.operators import moments as M
from compovec.operators import permutations as Y
from compovec.operators import ranks as R
from compovec.operators import resample as B
from compovec.operators import tables as S
from compovec.plans import fixtures as X
from compovec.plans.cohort import ALL, D, cohort
from compovec.plans.coordinates import with_size
from compovec.plans.labels import silver
from compovec.plans.registry import query
from compovec.plans.sqlkit import cte, lit, rnd, sql
from compovec.plans.text import rule_labels
from compovec.plans.vectors import rounded

RAND_DRAWS, SHARE_DRAWS, DIRECTION_DRAWS = 10_000, 5_000, 2_000

cte("emb", "SELECT vec_id, label, dim, x FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)")


def embeddings(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query("silhouette_squared", "STA-12",
       sql("SELECT vec_id, " + rnd("(b - a) / greatest(a, b)") + " AS silhouette FROM (SELECT vec_id, max(CASE WHEN own THEN t / (n - 1) END) AS a, min(CASE WHEN NOT own THEN t / n END) AS b FROM "
           "(SELECT p.vec_id, p.label = c.label AS own, any_value(c.n) AS n, any_value(c.n) * sum(p.x * p.x) + any_value(q) - 2 * sum(p.x * s) AS t FROM emb p JOIN "
           "(SELECT label, dim, sum(x) AS s, count(*)::DOUBLE AS n FROM emb GROUP BY ALL) c USING (dim) JOIN (SELECT label, sum(x * x) AS q FROM emb GROUP BY 1) d ON d.label = c.label "
           "GROUP BY p.vec_id, c.label, own) GROUP BY 1)", "emb"))
def _(spark, sf):
    s = K.silhouette_squared(embeddings(spark, sf), "x", "label", 64)
    return rounded(s.select("vec_id", "silhouette"), "silhouette")


@query("silhouette_exact", "STA-12 JN-12",
       "WITH d AS (SELECT a.vec_id, a.label = b.label AS own, b.label, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS t, count(*) AS n FROM embeddings a, embeddings b GROUP BY ALL) "
       "SELECT vec_id, " + rnd("(b - a) / greatest(a, b)") + " AS silhouette FROM (SELECT vec_id, max(CASE WHEN own THEN t / (n - 1) END) AS a, min(CASE WHEN NOT own THEN t / n END) AS b FROM d GROUP BY 1)")
def _(spark, sf):
    s = K.silhouette_exact(embeddings(spark, sf), "x", "label", "vec_id")
    return rounded(s.select("vec_id", "silhouette"), "silhouette")


RUNS = ["l_suppkey % 3", "l_suppkey % 3 + (l_quantity > 40)::INT", "l_partkey % 4", "(l_suppkey + l_linenumber) % 3"]
cte("runs", " UNION ALL ".join(f"SELECT {i} AS run, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST({e} AS BIGINT) AS lab FROM lineitem" for i, e in enumerate(RUNS)))
ARI = ("CASE WHEN (sa + sb) / 2 = sa * sb / c2 THEN 1e0 ELSE (ix - sa * sb / c2) / ((sa + sb) / 2 - sa * sb / c2) END")


@query("labeling_pair_agreement", "STA-13 STA-14 JN-11",
       "WITH w AS (SELECT " + ", ".join(f"CAST({e} AS BIGINT) AS r{i}" for i, e in enumerate(RUNS)) + " FROM lineitem), p AS (" +
       " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, r{i} AS x, r{j} AS y FROM w" for i in range(4) for j in range(i + 1, 4)) +
       "), c AS (SELECT a, b, x, y, count(*)::DOUBLE AS n FROM p GROUP BY ALL), t AS (SELECT a, b, sum(n * (n - 1) / 2) AS ix, sum(n) * (sum(n) - 1) / 2 AS c2 FROM c GROUP BY ALL), "
       "ra AS (SELECT a, b, sum(m * (m - 1) / 2) AS sa FROM (SELECT a, b, x, sum(n) AS m FROM c GROUP BY ALL) GROUP BY a, b), rb AS (SELECT a, b, sum(m * (m - 1) / 2) AS sb FROM "
       f"(SELECT a, b, y, sum(n) AS m FROM c GROUP BY ALL) GROUP BY a, b) SELECT a, b, {rnd(ARI)} AS ari FROM t JOIN ra USING (a, b) JOIN rb USING (a, b)")
def _(spark, sf):
    li = X.table(spark, sf, "lineitem")
    labs = li.select((F.col("l_suppkey") % 3).alias("r0"), (F.col("l_suppkey") % 3 + (F.col("l_quantity") > 40).cast("int")).alias("r1"),
                     (F.col("l_partkey") % 4).alias("r2"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 3).alias("r3"))
    # the runs of a row are a short array, so pairs are unfolded in the row and combined map-side
    pairs = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"r{i}").alias("x"), F.col(f"r{j}").alias("y")) for i in range(4) for j in range(i + 1, 4)])
    return rounded(E.adjusted_rand(labs.select(F.inline(pairs)), "x", "y", ["a", "b"]).drop("n"), "ari")


cte("limits", "SELECT label, sum(n) OVER (ORDER BY label) AS hi, sum(n) OVER (ORDER BY label) - n AS lo FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def keyed_places(suffix: str, n_draws: int, table: str, key: str, columns: str, *needs: str) -> None:
    """CTE ``perm_<suffix>``: place ``rk`` of every row in every draw; swap-or-not rounds as a fold over the rounds' keys."""
    cte(f"round_keys_{suffix}", "SELECT b, list({'x': 0::BIGINT, 'k': k, 'a': a, 'c': c} ORDER BY r) AS ks FROM (SELECT b, r, " + ", ".join(
        f"CAST('0x' || substr(md5(b || '-' || r), {at}, 7) AS BIGINT){plus} AS {name}" for name, at, plus in (("k", 1, f" % (SELECT count(*) FROM {table})"), ("a", 8, " + 1"), ("c", 15, "")))
        + f" FROM (SELECT unnest(range({n_draws})) AS b), (SELECT unnest(range({Y.ROUNDS})) AS r)) GROUP BY b", *needs)
    cte(f"perm_{suffix}", f"SELECT b, {columns}, 1 + list_reduce(list_prepend({{'x': i, 'k': 0::BIGINT, 'a': 0::BIGINT, 'c': 0::BIGINT}}, ks), lambda s, e: {{'x': CASE WHEN "
        f"((greatest(s.x, (e.k - s.x + n) % n) * e.a + e.c) % {Y.P}) % 2 = 1 THEN (e.k - s.x + n) % n ELSE s.x END, 'k': n, 'a': n, 'c': n}}).x AS rk FROM (SELECT {columns}, "
        f"(row_number() OVER (ORDER BY md5('base-' || {key}), {key}) - 1)::BIGINT AS i, count(*) OVER () AS n FROM {table}), round_keys_{suffix}", f"round_keys_{suffix}", *needs)


for suffix, n_draws in (("rand", RAND_DRAWS), ("share", SHARE_DRAWS)):
    keyed_places(suffix, n_draws, "embeddings", "vec_id", "vec_id, label")
    cte(f"shuffled_{suffix}", f"SELECT p.b, p.vec_id, p.label, l.label AS grp FROM perm_{suffix} p JOIN limits l ON p.rk > l.lo AND p.rk <= l.hi", f"perm_{suffix}", "limits")


@query("permuted_rand_index", "STA-16",
       sql("SELECT b, count(*) AS draws, " + rnd("avg(ari)") + " AS ari FROM (WITH c AS (SELECT b, label, grp, count(*)::DOUBLE AS n FROM shuffled_rand GROUP BY ALL), t AS (SELECT b, sum(n * (n - 1) / 2) AS ix, "
           "sum(n) * (sum(n) - 1) / 2 AS c2 FROM c GROUP BY 1), ra AS (SELECT b, sum(m * (m - 1) / 2) AS sa FROM (SELECT b, label, sum(n) AS m FROM c GROUP BY ALL) GROUP BY b), "
           "rb AS (SELECT b, sum(m * (m - 1) / 2) AS sb FROM (SELECT b, grp, sum(n) AS m FROM c GROUP BY ALL) GROUP BY b) "
           f"SELECT b, {ARI} AS ari FROM t JOIN ra USING (b) JOIN rb USING (b)) GROUP BY 1", "shuffled_rand"))
def _(spark, sf):
    r = Y.permuted_rand(embeddings(spark, sf).drop("x"), "label", ["vec_id"], RAND_DRAWS)
    return rounded(r.groupBy("b").agg(F.count("*").alias("draws"), F.avg("ari").alias("ari")), "ari")


@query("variance_partition", "STA-18",
       sql("SELECT " + rnd("t", 6) + " AS total, " + rnd("w", 6) + " AS within, " + rnd("(t - w) / t") + " AS eta2 FROM (SELECT sum((x - g) ** 2) AS t, sum((x - m) ** 2) AS w FROM "
           "(SELECT x, avg(x) OVER (PARTITION BY dim) AS g, avg(x) OVER (PARTITION BY dim, label) AS m FROM emb))", "emb"))
def _(spark, sf):
    v = M.variance_partition(embeddings(spark, sf), "x", 64, "label").select("total", "within", "eta2")
    return rounded(rounded(v, "total", "within", digits=6), "eta2")


cte("share_sums", "SELECT s.b, s.grp, (" + " + ".join(f"sum(e.embedding[{i}]::DOUBLE) ** 2" for i in range(1, 65)) + ") / count(*) AS ss FROM shuffled_share s JOIN embeddings e USING (vec_id) GROUP BY ALL", "shuffled_share")


@query("permuted_variance_share", "STA-19",
       sql("SELECT b, " + rnd("(sum(ss) - any_value(g)) / any_value(q - g)") + " AS eta2 FROM share_sums, (SELECT sum(sx * sx / n) AS g, sum(q) AS q FROM (SELECT sum(x) AS sx, sum(x * x) AS q, count(*) AS n FROM emb GROUP BY dim)) GROUP BY 1",
           "share_sums", "emb"))
def _(spark, sf):
    return rounded(Y.permuted_eta2(embeddings(spark, sf), "x", 64, "label", ["vec_id"], SHARE_DRAWS).select("b", "eta2"), "eta2")


cte("units", "SELECT report_id, ord, clr_res / greatest(sqrt(sum(clr_res * clr_res) OVER (PARTITION BY report_id)), 1e-10) AS u FROM clr_res", "clr_res")
keyed_places("direction", DIRECTION_DRAWS, "sizes", "report_id", "report_id", "sizes")
cte("dir_perm", "SELECT b, report_id FROM perm_direction WHERE rk <= (SELECT count(*) FROM tail_rows)", "perm_direction", "tail_rows")


def cos_sql(members: str) -> str:
    return (f"(SELECT b, (sum(s * s) - any_value(q)) / (any_value(m) * (any_value(m) - 1)) AS cosine FROM (SELECT t.b, u.ord, sum(u.u) AS s FROM {members} t JOIN units u USING (report_id) GROUP BY ALL) "
            f"JOIN (SELECT t.b, sum(u.u * u.u) AS q, count(DISTINCT report_id) AS m FROM {members} t JOIN units u USING (report_id) GROUP BY 1) USING (b) GROUP BY 1)")


@query("outlier_direction_test", "STA-17",
       sql("SELECT o.m AS n_outliers, " + rnd("o.cosine", 7) + " AS cosine, " + rnd("p.null_mean", 7) + " AS null_mean, " + rnd("p.null95", 7) + " AS null95, " + rnd("p.ge / p.n") +
           " AS p_value, CASE WHEN o.m < 3 THEN 'INSUFFICIENT_OUTLIERS' WHEN o.cosine <= p.null95 THEN 'DIVERSE_DIRECTION' ELSE 'SHARED_DIRECTION' END AS verdict FROM (SELECT cosine, (SELECT count(*) FROM tail_rows) AS m FROM " +
           cos_sql("(SELECT 0 AS b, report_id FROM tail_rows)") + ") o, (SELECT avg(cosine) AS null_mean, quantile_cont(cosine, 0.95) AS null95, count(*) AS n, count(*) FILTER (cosine >= (SELECT cosine FROM " +
           cos_sql("(SELECT 0 AS b, report_id FROM tail_rows)") + ")) AS ge FROM " + cos_sql("dir_perm") + ") p", "units", "tail_rows", "dir_perm"))
def _(spark, sf):
    c = with_size(cohort(spark, sf)).select("report_id", "clr_res", "size")
    obs, null = K.direction_test(c, "clr_res", D, "size", ["report_id"], DIRECTION_DRAWS)
    enough = F.col("n_outliers") >= 3
    o = obs.select(F.lit(1).alias("_k"), F.col("m").alias("n_outliers"), "cosine").withColumn("cosine", F.when(enough, F.col("cosine")))
    n = null.select(F.lit(1).alias("_k"), F.col("cosine").alias("c"))
    p = R.percentiles(n, "c", [0.95], ["_k"], ["null95"])
    j = o.join(n, "_k", "left").groupBy("_k", "n_outliers", "cosine").agg(F.avg("c").alias("null_mean"), (F.count_if(F.col("c") >= F.col("cosine")) / F.nullif(F.count("c"), F.lit(0))).alias("p_value"))
    j = j.join(p, "_k", "left").drop("_k")
    # fixed values: the verdicts
    j = j.withColumn("verdict", F.when(~enough, "INSUFFICIENT_OUTLIERS").when(F.col("cosine") <= F.col("null95"), "DIVERSE_DIRECTION").otherwise("SHARED_DIRECTION"))
    return rounded(rounded(j, "cosine", "null_mean", "null95", digits=7), "p_value")


# ---------------------------------------------------------------- random selections
N_DRAWS = 5
cte("silver_keys", "SELECT DISTINCT report_id, sentence_idx FROM silver", "silver")
cte("random_sel", f"SELECT b, report_id, sentence_idx, row_number() OVER (PARTITION BY report_id, b ORDER BY md5(b::VARCHAR || '-' || report_id || '-' || sentence_idx::VARCHAR)) AS rank "
    f"FROM silver_keys, (SELECT unnest(range({N_DRAWS})) AS b)", "silver_keys")


def random_sel(spark, sf, k, draws=N_DRAWS):
    keys = silver(spark, sf).select(*C.KEYS).distinct()
    return B.random_k(keys, k, draws, ["report_id"], ["sentence_idx"])


@query("random_sentences", "WIN-14", sql("SELECT b, report_id, sentence_idx, CAST(rank AS INT) AS rank FROM random_sel WHERE rank <= 3", "random_sel"))
def _(spark, sf):
    return random_sel(spark, sf, 3)


@query("random_control_sentence", "WIN-20", sql("SELECT report_id, sentence_idx FROM random_sel WHERE rank = 1 AND b = 0", "random_sel"))
def _(spark, sf):
    return random_sel(spark, sf, 1, 1).select("report_id", "sentence_idx")


@query("weighted_sentences", "WIN-15")
def _(spark, sf):
    imp = I.importance(X.edges(spark, sf))
    return B.weighted_k(imp, "importance", 5, ["report_id"], ["sentence_idx"])


@query("split_halves", "WIN-16",
       sql("SELECT report_id, sentence_idx, domain_id, CASE WHEN row_number() OVER (PARTITION BY report_id ORDER BY md5('0-' || report_id || '-' || sentence_idx::VARCHAR || '-' || domain_id), sentence_idx, domain_id) <= "
           "floor(count(*) OVER (PARTITION BY report_id) / 2) THEN 1 ELSE 2 END AS half FROM silver", "silver"))
def _(spark, sf):
    return B.halves(silver(spark, sf), ["report_id"], ["sentence_idx", "domain_id"]).select(*C.KEYS, "domain_id", "half")


# ---------------------------------------------------------------- content of the selection
cte("sel_weight", "SELECT report_id, sentence_idx, domain_id, 1e0 / count(*) OVER (PARTITION BY report_id, sentence_idx) AS w FROM silver SEMI JOIN domains ON domains.id = silver.domain_id", "silver", "domains")
cte("sent_imp", "SELECT report_id, sentence_idx, row_number() OVER (PARTITION BY report_id ORDER BY max(confidence) DESC, sentence_idx) AS rank FROM silver GROUP BY report_id, sentence_idx", "silver")
cte("enrich", "SELECT d.code, d.id AS domain_id, coalesce(sum(w) FILTER (top), 0e0) AS h, coalesce(sum(w) FILTER (NOT top), 0e0) AS l FROM domains d LEFT JOIN (SELECT s.domain_id, s.w, i.rank <= 2 AS top FROM sel_weight s "
    "JOIN sent_imp i USING (report_id, sentence_idx)) x ON x.domain_id = d.id GROUP BY ALL", "domains", "sel_weight", "sent_imp")
cte("enrich_z", "SELECT *, (h / ht - l / lt) / sqrt((h + l) / (ht + lt) * (1 - (h + l) / (ht + lt)) * (1 / ht + 1 / lt)) AS z, ln(((h + 0.5) / (ht - h + 0.5)) / ((l + 0.5) / (lt - l + 0.5))) AS log_odds FROM "
    "(SELECT *, sum(h) OVER () AS ht, sum(l) OVER () AS lt FROM enrich)", "enrich")


def enrichment(spark, sf):
    labels = C.nest(silver(spark, sf))
    imp = silver(spark, sf).groupBy(*C.KEYS).agg(F.max("confidence").alias("importance"))
    top = I.top_k(imp, 2).select(*C.KEYS, F.lit(True).alias("top"))
    m = C.match(labels.select(*C.KEYS).join(top, C.KEYS, "left"), labels, ALL).withColumn("top", F.coalesce("top", F.lit(False)))
    mass = C.mass(m, by=["top"]).groupBy("domain_id").agg(F.sum(F.when(F.col("top"), F.col("w")).otherwise(0.0)).alias("high"), F.sum(F.when(~F.col("top"), F.col("w")).otherwise(0.0)).alias("low"))
    t = mass.agg(F.sum("high").alias("ht"), F.sum("low").alias("lt")).withColumn("_k", F.lit(1))
    j = mass.withColumn("_k", F.lit(1)).join(t, "_k").drop("_k")
    h, l, ht, lt = (F.col(c) for c in ("high", "low", "ht", "lt"))
    pool = (h + l) / (ht + lt)
    se = F.sqrt(pool * (1 - pool) * (1 / ht + 1 / lt))
    j = j.withColumn("se", se).withColumn("z", F.when(F.col("se") > 0, (h / ht - l / lt) / F.col("se")).otherwise(0.0)).drop("se")
    return j.withColumn("log_odds", F.ln(((h + 0.5) / (ht - h + 0.5)) / ((l + 0.5) / (lt - l + 0.5))))


@query("content_enrichment", "STA-28",
       sql(f"SELECT domain_id, {rnd('h', 6)} AS high, {rnd('l', 6)} AS low, {rnd('log_odds')} AS log_odds, {rnd('z', 7)} AS z FROM enrich_z WHERE h + l > 0", "enrich_z"))
def _(spark, sf):
    e = enrichment(spark, sf).drop("ht", "lt")
    return rounded(rounded(rounded(e, "high", "low", digits=6), "log_odds"), "z", digits=7)


@query("content_enrichment_q", "STA-28 WIN-7 FN-3")
def _(spark, sf):
    e = enrichment(spark, sf).select("domain_id", "log_odds", "z").withColumn("p", special.normal_p_udf("z"))
    return S.benjamini_hochberg(e)
