"""Summaries, cohort tables, joins with fallbacks, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from compovec.functions import arrays as A
from compovec.functions import text as T
from compovec.operators import agreement as E
from compovec.operators import composition as C
from compovec.operators import importance as I
from compovec.operators import labels as L
from compovec.operators import ranks as R
from compovec.operators import resample as B
from compovec.operators import segment
from compovec.operators import tables as S
from compovec.operators import votes as V
from compovec.plans import fixtures as X
from compovec.plans.agreement import gold, predictions
from compovec.plans.cohort import ALL, D, cohort, compositions
from compovec.plans.labels import sheet, silver
from compovec.plans.registry import query
from compovec.plans.sqlkit import cte, lit, rnd, sql, strip
from compovec.plans.text import WORD_CLASS
from compovec.plans.vectors import rounded, top10
from compovec.sources import ontology


@query("load_domains", "SRC-5",
       sql("SELECT d.ord, d.code, d.id, d.grp, d.pilot_active, count(s.domain_id) AS used FROM domains d LEFT JOIN silver s ON s.domain_id = d.id GROUP BY ALL",
           "domains", "silver"))
def _(spark, sf):
    d = ontology.load_domains(spark).select("ord", "code", "id", F.col("group").alias("grp"), "pilot_active")
    used = silver(spark, sf).groupBy(F.col("domain_id").alias("id")).agg(F.count("*").alias("used"))
    return d.join(used, "id", "left").fillna(0, ["used"])


@query("label_file_summary", "AGG-1 SNK-5",
       sql("SELECT count(*) AS total, count(*) FILTER (failed) AS errors, count(*) FILTER (NOT failed AND n = 0) AS unlabeled, count(*) FILTER (n >= 2) AS multi, "
           "sum(n)::BIGINT AS labels, count(DISTINCT report_id) AS reports, " + rnd("sum(n) / count(*) FILTER (NOT failed AND n > 0)") + " AS labels_per_sentence "
           "FROM (SELECT s.report_id, s.sentence_idx, f.error IS NOT NULL AS failed, count(v.domain_id) AS n FROM (SELECT DISTINCT report_id, sentence_idx FROM votes) s "
           "LEFT JOIN vote_failed f USING (report_id, sentence_idx) LEFT JOIN voted v USING (report_id, sentence_idx) GROUP BY ALL)", "votes", "vote_failed", "voted"))
def _(spark, sf):
    return rounded(S.label_summary(V.consolidate(V.parse_votes(X.votes(spark, sf)))), "labels_per_sentence")


@query("label_file_domains", "AGG-1 SNK-5",
       sql("SELECT coalesce(d.code, '?') AS code, s.domain_id, count(*) AS n, " + rnd("count(*) * 100 / (SELECT count(*) FROM (SELECT DISTINCT report_id, sentence_idx FROM silver))") +
           " AS percent, " + rnd("avg(confidence)") + " AS mean_confidence FROM silver s LEFT JOIN domains d ON d.id = s.domain_id GROUP BY ALL", "silver", "domains"))
def _(spark, sf):
    rows = silver(spark, sf)
    total = rows.select(*L.KEYS).distinct().agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    d = rows.groupBy("domain_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")).withColumn("_k", F.lit(1))
    d = d.join(total, "_k").withColumn("percent", F.col("n") / F.greatest(F.lit(1), F.col("total")) * 100).drop("_k", "total")
    m = F.create_map(*[F.lit(x) for c in ontology.domains() for x in (c[1], c[0])])
    return rounded(d.withColumn("code", F.coalesce(m[F.col("domain_id")], F.lit("?"))), "percent", "mean_confidence")


@query("gold_distribution", "AGG-2",
       sql("SELECT d.ord, d.code, d.id AS domain_id, count(g.domain_id) AS n FROM domains d LEFT JOIN gold g ON g.domain_id = d.id GROUP BY ALL", "domains", "gold"))
def _(spark, sf):
    return S.domain_distribution(gold(spark, sf), ontology.load_domains(spark))


@query("label_cardinality", "AGG-2", sql("SELECT n AS n_labels, count(*) AS sentences FROM (SELECT count(*) AS n FROM gold GROUP BY report_id, sentence_idx) GROUP BY 1", "gold"))
def _(spark, sf):
    return S.cardinality(gold(spark, sf))


@query("cohort_cross_table", "AGG-3 SET-5",
       sql("SELECT coalesce(dx, 'all') AS dx, coalesce(type, 'all') AS type, count(*) AS reports, count(DISTINCT person) AS people FROM (SELECT CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS dx, "
           "substring(split_part(report_id, '-', -1), 1, 1) AS type, regexp_replace(report_id, '(?:-[0-9]+)?-[AP][0-9]+$', '') AS person FROM labels l JOIN reports USING (doc_id)) "
           "GROUP BY CUBE (dx, type)", "reports"))
def _(spark, sf):
    m = X.table(spark, sf, "labels").select(X.report_id().alias("report_id"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("dx"))
    m = m.withColumn("type", T.report_type(F.col("report_id"))).withColumn("person", T.person_id(F.col("report_id")))
    return S.cohort_table(m, "dx", "type", "person").fillna("all", ["dx", "type"])


@query("conversation_cross_table", "AGG-3",
       "SELECT coalesce(role, 'all') AS role, coalesce(parity, -1) AS parity, count(*) AS reports, count(DISTINCT conv_id) AS people FROM "
       "(SELECT role, conv_id % 2 AS parity, conv_id FROM conversations) GROUP BY CUBE (role, parity)")
def _(spark, sf):
    c = X.table(spark, sf, "conversations").select("role", (F.col("conv_id") % 2).alias("parity"), "conv_id")
    return S.cohort_table(c, "role", "parity", "conv_id").fillna({"role": "all", "parity": -1})


@query("metric_median_by_group", "AGG-17",
       sql("SELECT d.grp, " + rnd("median(f)") + " AS f1 FROM per_domain p JOIN domains d ON d.id = p.domain_id GROUP BY 1".replace("d.grp", "d.grp"), "per_domain", "domains"))
def _(spark, sf):
    p = E.per_domain(E.counts(E.paired_sets(gold(spark, sf), silver(spark, sf)), ALL), digits=None)
    p = p.withColumn("grp", F.substring(F.get(F.array(*[F.lit(c) for c in ontology.codes()]), F.col("ord")), 1, 2))
    return rounded(R.percentiles(p, "f1", [0.5], ["grp"], ["f1"]), "f1")


# words of the most attended sentence of every labelled report
cte("attended", "SELECT r.report_id, s.sentence, CAST(m.final_diag AS INT) AS label FROM ranked r JOIN sentences s USING (report_id, sentence_idx) JOIN metadata m ON m.code = r.report_id "
    "WHERE r.rank = 1 AND NOT isnan(m.final_diag)", "ranked", "sentences", "metadata")
cte("att_words", f"SELECT label, trim(w, {lit(T.PUNCTUATION)}) AS word FROM (SELECT label, unnest(list_filter(regexp_split_to_array({strip('sentence')}, {lit(WORD_CLASS)}), "
    "lambda w: w <> '')) AS w FROM attended)", "attended")
cte("att_freq", "SELECT word, count(*) FILTER (label = 1) / (SELECT count(*) FILTER (label = 1) FROM attended) AS pf, count(*) FILTER (label = 0) / (SELECT count(*) FILTER (label = 0) FROM attended) AS nf "
    "FROM att_words GROUP BY 1", "att_words", "attended")


@query("word_enrichment", "AGG-18 JN-10",
       sql("SELECT word, " + ", ".join(f"{rnd(e)} AS {n}" for e, n in (("pf", "pos_freq"), ("nf", "neg_freq"), ("pf - nf", "diff"))) + ", " +
           ", ".join(f"{rnd(e, 6)} AS {n}" for e, n in (("pf / (nf + 1e-6)", "pos_ratio"), ("nf / (pf + 1e-6)", "neg_ratio"))) + " FROM att_freq WHERE pf >= 0.01 OR nf >= 0.01", "att_freq"))
def _(spark, sf):
    known = segment.with_diagnosis(X.reports(spark, sf).select("report_id"), X.metadata(spark, sf))
    top = I.most_attended(I.importance(X.edges(spark, sf))).join(known, "report_id")
    sent = X.sentences(spark, sf).join(top.select(*L.KEYS, "label"), L.KEYS)
    w = segment.explode_words(sent, ["label"])
    sizes = known.groupBy("label").agg(F.count("*").alias("reports"))
    e = S.word_enrichment(w, sizes)
    return rounded(rounded(e, "pos_freq", "neg_freq", "diff"), "pos_ratio", "neg_ratio", digits=6)


@query("top_enriched_words", "AGG-18 WIN-19",
       sql("(SELECT 'pos' AS side, word, " + rnd("pf / (nf + 1e-6)", 6) + " AS ratio FROM att_freq WHERE pf >= 0.01 OR nf >= 0.01 ORDER BY round(pf / (nf + 1e-6), 6) DESC, word LIMIT 30) UNION ALL "
           "(SELECT 'neg', word, " + rnd("nf / (pf + 1e-6)", 6) + " FROM att_freq WHERE pf >= 0.01 OR nf >= 0.01 ORDER BY round(nf / (pf + 1e-6), 6) DESC, word LIMIT 30)", "att_freq"))
def _(spark, sf):
    from compovec.plans.registry import CATALOGUE
    e = CATALOGUE["word_enrichment"].run(spark, sf)
    pick = lambda side, col: e.orderBy(F.desc(col), "word").limit(30).select(F.lit(side).alias("side"), "word", F.col(col).alias("ratio"))
    return pick("pos", "pos_ratio").unionByName(pick("neg", "neg_ratio"))


@query("metric_summary", "AGG-19",
       "SELECT l_returnflag, count(*) AS n, " + rnd("avg(l_extendedprice)", 4) + " AS mean, " + rnd("stddev_samp(l_extendedprice)", 4) + " AS sd, " +
       rnd("median(l_extendedprice)", 4) + " AS median, " + rnd("quantile_cont(l_extendedprice, 0.025)", 4) + " AS lo, " + rnd("quantile_cont(l_extendedprice, 0.975)", 4) +
       " AS hi, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def _(spark, sf):
    return rounded(R.summary(X.table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]), "mean", "sd", "median", "lo", "hi", digits=4)


EMB = "SELECT vec_id // 5 AS report, vec_id % 5 AS sentence_idx, embedding, vec_id % 3 <> 0 AS valid FROM embeddings"


@query("pool_sentence_vectors", "AGG-20",
       f"WITH e AS ({EMB}), u AS (SELECT report, sentence_idx, valid, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM e), "
       "a AS (SELECT report, dim, avg(x::DOUBLE) FILTER (valid) AS m, arg_min(x::DOUBLE, sentence_idx) AS f FROM u GROUP BY ALL) "
       f"SELECT report, CAST(dim AS INT) AS dim, {rnd('coalesce(m, f)')} AS x FROM a")
def _(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.expr("vec_id div 5").alias("report"), (F.col("vec_id") % 5).alias("sentence_idx"),
                                                "embedding", (F.col("vec_id") % 3 != 0).alias("valid"))
    p = S.pool_vectors(e, "embedding", 64, "valid", key="report")
    return rounded(p.select("report", F.posexplode_outer("embedding").alias("dim", "x")), "x")


@query("fold_metric_summary", "AGG-21",
       sql(f"SELECT {rnd('avg(acc)')} AS accuracy_mean, {rnd('stddev_pop(acc)')} AS accuracy_sd FROM (SELECT fold, avg(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END) AS acc FROM probs GROUP BY 1)", "probs"))
def _(spark, sf):
    from compovec.operators import classify as K
    p = K.with_probability(predictions(spark, sf))
    folds = p.groupBy("fold").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    return rounded(S.fold_summary(folds, ["accuracy"]), "accuracy_mean", "accuracy_sd")


@query("density_histogram", "AGG-23",
       "SELECT CAST(bin AS INT) AS bin, n, " + rnd("CASE WHEN bin BETWEEN 0 AND 39 THEN n / (sum(n) FILTER (bin BETWEEN 0 AND 39) OVER () * 2500e0) END", 10) + " AS density FROM (SELECT CASE WHEN l_extendedprice < 0 THEN -1 "
       "WHEN l_extendedprice > 100000 THEN 40 ELSE least(39, floor(l_extendedprice / 2500)) END AS bin, count(*) AS n FROM lineitem GROUP BY 1)")
def _(spark, sf):
    return rounded(S.histogram(X.table(spark, sf, "lineitem"), "l_extendedprice", 0.0, 100000.0, 40), "density", digits=10)


@query("density_histogram_whole", "AGG-23",
       "WITH x AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem), r AS (SELECT min(x) AS lo, (max(x) - min(x)) / 40e0 AS width FROM x) "
       "SELECT CAST(bin AS INT) AS bin, n, " + rnd("n / (sum(n) OVER () * width)", 10) + " AS density FROM (SELECT least(39, floor((x - lo) / width)) AS bin, any_value(width) AS width, count(*) AS n FROM x, r GROUP BY 1)")
def _(spark, sf):
    return rounded(S.histogram(X.table(spark, sf, "lineitem"), "l_extendedprice", None, None, 40), "density", digits=10)


# ---------------------------------------------------------------- joins
@query("two_hop_pairing", "JN-4",
       sql("SELECT t.report_id, t.rank, CAST(count(g.txt) AS BIGINT) AS n_gold, CASE WHEN count(g.txt) = 0 THEN 'missing' WHEN count(g.txt) > 1 THEN 'duplicated' ELSE 'paired' END AS status "
           "FROM (SELECT report_id, CAST(rank AS INT) AS rank, sentence_idx FROM top10) t JOIN sentences s USING (report_id, sentence_idx) LEFT JOIN (SELECT report_id, " + strip("sentence") +
           " AS txt FROM sheet WHERE report_id IS NOT NULL AND sentence IS NOT NULL) g ON g.report_id = t.report_id AND g.txt = " + strip("s.sentence") + " GROUP BY t.report_id, t.rank",
           "top10", "sentences", "sheet"))
def _(spark, sf):
    picked = X.sentences(spark, sf).join(top10(spark, sf), L.KEYS).select("report_id", "rank", T.strip(F.col("sentence")).alias("txt"))
    g = sheet(spark, sf).filter("report_id is not null and sentence is not null").select("report_id", T.strip(F.col("sentence")).alias("txt"))
    g = g.groupBy("report_id", "txt").agg(F.count("*").alias("n_gold"))
    j = picked.join(g, ["report_id", "txt"], "left").fillna(0, ["n_gold"])
    status = F.when(F.col("n_gold") == 0, "missing").when(F.col("n_gold") > 1, "duplicated").otherwise("paired")
    return j.select("report_id", "rank", "n_gold", status.alias("status"))


@query("diagnosis_by_report_or_person", "JN-6",
       sql("SELECT r.report_id, coalesce(m.dx, p.dx, 'NA') AS dx FROM reports r LEFT JOIN mdx m ON m.code = r.report_id LEFT JOIN (SELECT person, arg_max(dx, code) AS dx FROM mdx q GROUP BY 1) p "
           "ON p.person = regexp_replace(r.report_id, '(?:-[0-9]+)?-[AP][0-9]+$', '')".replace("mdx", "(SELECT code, CASE WHEN final_diag = 1 THEN 'yes' ELSE 'no' END AS dx, "
           "regexp_replace(code, '(?:-[0-9]+)?-[AP][0-9]+$', '') AS person FROM metadata)"), "reports", "metadata"))
def _(spark, sf):
    meta = X.metadata(spark, sf).withColumn("dx", F.when(F.col("final_diag") == 1, "yes").otherwise("no"))
    return S.diagnosis_or_person(X.reports(spark, sf).select("report_id"), meta, T.person_id)


@query("full_outer_frequencies", "JN-10",
       "SELECT coalesce(a.c, b.c) AS event_type, coalesce(a.f, 0e0) AS small, coalesce(b.f, 0e0) AS large FROM (SELECT event_type || floor(value)::INT % 7 AS c, count(*)::DOUBLE AS f FROM events WHERE value < 10 GROUP BY 1) a "
       "FULL JOIN (SELECT event_type || floor(value)::INT % 5 AS c, count(*)::DOUBLE AS f FROM events WHERE value >= 10 GROUP BY 1) b ON a.c = b.c")
def _(spark, sf):
    e = X.table(spark, sf, "events")
    def freq(cond, mod, name):
        c = F.concat("event_type", (F.floor("value").cast("int") % mod).cast("string"))
        return e.filter(cond).groupBy(c.alias("event_type")).agg(F.count("*").cast("double").alias(name))
    return S.outer_zero(freq(F.col("value") < 10, 7, "small"), freq(F.col("value") >= 10, 5, "large"), ["event_type"], ["small", "large"])


@query("run_pairs", "JN-11",
       "WITH r AS (SELECT l_returnflag || l_linestatus AS run, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT a.run AS run_a, b.run AS run_b, a.q - b.q AS diff FROM r a JOIN r b ON a.run < b.run")
def _(spark, sf):
    runs = X.table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("run")).agg(F.sum("l_quantity").alias("q"))
    # numbered runs: each one names the numbers after its own, and an equi-join brings their values
    n = B.hash_rank(runs, [], ["run"], F.lit("runs"))
    later = n.filter("pos < pos_n").select("run", "q", F.explode(F.sequence(F.col("pos") + 1, F.col("pos_n"))).alias("pos"))
    p = later.join(n.select("pos", F.col("run").alias("other"), F.col("q").alias("other_q")), "pos")
    first = F.col("run") < F.col("other")
    return p.select(F.least("run", "other").alias("run_a"), F.greatest("run", "other").alias("run_b"),
                    F.when(first, F.col("q") - F.col("other_q")).otherwise(F.col("other_q") - F.col("q")).alias("diff"))


@query("result_table", "JN-13 SNK-6 SNK-7",
       sql("SELECT d.code, d.name, d.grp, CAST(p.support AS BIGINT) AS support, CASE WHEN p.tp + p.fp > 0 THEN round(round(p.tp / (p.tp + p.fp), 12), 3) END AS precision FROM per_domain p JOIN domains d ON d.id = p.domain_id",
           "per_domain", "domains"))
def _(spark, sf):
    c = E.counts(E.paired_sets(gold(spark, sf), silver(spark, sf)), ALL)
    c = c.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(float("nan"))))
    d = ontology.load_domains(spark).select("code", "name", F.col("group").alias("grp"), F.col("id").alias("domain_id"))
    t = S.to_null(c, ["precision"]).join(F.broadcast(d), "domain_id")
    return t.select("code", "name", "grp", "support", F.round(F.round("precision", 12), 3).alias("precision"))


@query("build_check", "JN-14",
       sql("SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, "
           + rnd("max(abs(a - b))", 6) + " AS max_diff FROM (SELECT s.prop AS a, g.prop AS b FROM (SELECT report_id, domain_id, n / sum(n) OVER (PARTITION BY report_id) AS prop FROM "
           "(SELECT report_id, domain_id, count(*) AS n FROM silver GROUP BY ALL)) s FULL JOIN (SELECT report_id, domain_id, n / sum(n) OVER (PARTITION BY report_id) AS prop FROM "
           "(SELECT report_id, domain_id, count(*) AS n FROM gold GROUP BY ALL)) g USING (report_id, domain_id))", "silver", "gold"))
def _(spark, sf):
    def build(labels):
        n = labels.groupBy("report_id", "domain_id").agg(F.count("*").alias("n"))
        return n.withColumn("prop", F.col("n") / F.sum("n").over(Window.partitionBy("report_id")))
    return rounded(S.build_check(build(silver(spark, sf)), build(gold(spark, sf)), ["report_id", "domain_id"], "prop"), "max_diff", digits=6)


@query("stability_table", "JN-15 SET-3",
       "WITH k AS (SELECT l_linenumber AS k, " + rnd("avg(l_discount) * 16", 6) + " AS seed_ari_mean, " + rnd("stddev_samp(l_tax)", 6) + " AS boot FROM lineitem GROUP BY 1) "
       "SELECT k, seed_ari_mean, CASE WHEN k <= 5 THEN boot END AS bootstrap, CASE WHEN seed_ari_mean >= 0.8 THEN 'yes' ELSE 'no' END AS stable, 'block' AS block FROM k "
       "UNION ALL SELECT k, NULL, boot, NULL, 'sweep' FROM k")
def _(spark, sf):
    li = X.table(spark, sf, "lineitem")
    k = li.groupBy(F.col("l_linenumber").alias("k")).agg((F.avg("l_discount") * 16).alias("seed_ari_mean"), F.stddev_samp("l_tax").alias("bootstrap"))
    k = rounded(k, "seed_ari_mean", "bootstrap", digits=6)
    t = S.stability_table(k.select("k"), k.select("k", "seed_ari_mean"), k.filter("k <= 5").select("k", "bootstrap"))
    sweep = k.select("k", "bootstrap", F.lit("sweep").alias("block"))
    return t.withColumn("block", F.lit("block")).unionByName(sweep, allowMissingColumns=True)


@query("wide_to_long", "SET-6 FN-1",
       "SELECT o_orderkey, measure, value FROM (UNPIVOT (SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS o_custkey FROM orders) ON o_totalprice, o_custkey INTO NAME measure VALUE value)")
def _(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return o.unpivot("o_orderkey", ["o_totalprice", "o_custkey"], "measure", "value")


@query("union_of_label_sets", "SET-3 SET-5",
       sql("SELECT DISTINCT report_id, sentence_idx, domain_id FROM (SELECT report_id, sentence_idx, domain_id FROM silver_items UNION ALL SELECT report_id, sentence_idx, domain_id FROM gold_items)", "silver_items", "gold_items"))
def _(spark, sf):
    cols = [*L.KEYS, "domain_id"]
    return L.union_sets(X.silver_items(spark, sf).select(cols).unionByName(X.gold_items(spark, sf).select(cols)))


@query("latest_run_rows", "WIN-18 FN-7",
       "WITH r AS (SELECT strftime(o_orderdate, '%Y%m') AS run, o_orderkey, o_totalprice FROM orders) SELECT * FROM r WHERE run = (SELECT max(run) FROM r)")
def _(spark, sf):
    o = X.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("run"), "o_orderkey", "o_totalprice")
    return S.latest_run(o)


@query("score_vectors_by_type", "JN-7 JN-8 STA-33 FN-8",
       sql("SELECT report_id, report_type, x1, x2, " + rnd("prop") + " AS prop FROM (SELECT " + "'PER-' || lpad(cast(o_custkey as string), 12, '0')" + " AS person, TRY_CAST(CASE WHEN o_custkey % 13 = 0 THEN 'missing' ELSE "
           "CAST(count(*) AS STRING) END AS DOUBLE) AS x1, max(o_totalprice) AS x2 FROM orders GROUP BY o_custkey) s JOIN comp c ON regexp_replace(c.report_id, '-[0-9]+-[AP][0-9]+$', '') = s.person "
           "WHERE ord = 0 AND x1 IS NOT NULL", "comp"))
def _(spark, sf):
    o = X.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").cast("string").alias("x1"), F.max("o_totalprice").alias("x2"))
    o = o.select(F.expr("'PER-' || lpad(cast(o_custkey as string), 12, '0')").alias("person"),
                 F.when(F.col("o_custkey") % 13 == 0, "missing").otherwise(F.col("x1")).alias("x1"), "x2")
    c = compositions(spark, sf).withColumn("person", T.person_id(F.col("report_id")))
    j = S.complete_cases(o, ["x1"]).join(c, "person")
    return rounded(j.select("report_id", "report_type", "x1", "x2", F.get("prop", F.lit(0)).alias("prop")), "prop")
