"""Label agreement, vote reliability and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from compovec.functions import text as T
from compovec.operators import agreement as E
from compovec.operators import classify as K
from compovec.operators import composition as C
from compovec.operators import labels as L
from compovec.operators import ranks as R
from compovec.operators import votes as V
from compovec.plans import fixtures as X
from compovec.plans.labels import sheet, silver
from compovec.plans.registry import query
from compovec.plans.sqlkit import cte, lit, rnd, sql, strip
from compovec.plans.text import rule_labels
from compovec.plans.vectors import rounded
from compovec.session import materialise
from compovec.sources import ontology

ALL = ontology.ids()

cte("common_keys", "SELECT report_id, sentence_idx FROM (SELECT DISTINCT report_id, sentence_idx FROM gold) SEMI JOIN silver "
    "USING (report_id, sentence_idx)", "gold", "silver")
cte("status", "SELECT report_id, sentence_idx, domain_id, g.pos IS NOT NULL AS in_g, s.pos IS NOT NULL AS in_s FROM "
    "(SELECT * FROM gold SEMI JOIN common_keys USING (report_id, sentence_idx)) g FULL JOIN "
    "(SELECT * FROM silver SEMI JOIN common_keys USING (report_id, sentence_idx)) s USING (report_id, sentence_idx, domain_id)",
    "gold", "silver", "common_keys")


def per_domain_sql(status: str) -> str:
    return ("SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END AS f FROM (SELECT *, "
            "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS r "
            "FROM (SELECT d.ord, d.id AS domain_id, d.grp, count(*) FILTER (in_g AND in_s) AS tp, count(*) FILTER (in_s AND NOT in_g) AS fp, "
            f"count(*) FILTER (in_g AND NOT in_s) AS fn, count(*) FILTER (in_g) AS support FROM domains d LEFT JOIN {status} s "
            "ON s.domain_id = d.id GROUP BY ALL))")


cte("per_domain", per_domain_sql("status"), "domains", "status")


def gold(spark, sf):
    return L.canonical(X.gold_items(spark, sf).withColumn("confidence", F.lit(1.0)))


def paired(spark, sf):
    return E.paired_sets(gold(spark, sf), silver(spark, sf))


@query("multilabel_per_domain", "EVL-1 SNK-5 JN-2",
       sql("SELECT ord, domain_id, tp, fp, fn, support, round(round(p, 12), 4) AS precision, round(round(r, 12), 4) AS recall, "
           "round(round(f, 12), 4) AS f1 FROM per_domain", "per_domain"))
def _(spark, sf):
    return E.per_domain(E.counts(paired(spark, sf), ALL))


def roll_up_sql(rounded_first: bool) -> str:
    q = (lambda c: f"round(round({c}, 12), 4)") if rounded_first else (lambda c: c)
    return (f"SELECT {rnd('avg(' + q('p') + ') FILTER (support > 0)')} AS macro_supported_precision, "
            f"{rnd('avg(' + q('r') + ') FILTER (support > 0)')} AS macro_supported_recall, "
            f"{rnd('avg(' + q('f') + ') FILTER (support > 0)')} AS macro_supported_f1, {rnd('avg(' + q('f') + ')')} AS macro_all_f1, "
            f"{rnd('sum(' + q('f') + ' * support) / sum(support)')} AS weighted_f1, {rnd('sum(tp) / (sum(tp) + sum(fp))')} AS micro_precision, "
            f"{rnd('sum(tp) / (sum(tp) + sum(fn))')} AS micro_recall, "
            f"{rnd('2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))')} AS micro_f1 ")


ROLL = ["macro_supported_precision", "macro_supported_recall", "macro_supported_f1", "macro_all_f1", "weighted_f1",
        "micro_precision", "micro_recall", "micro_f1"]


@query("multilabel_roll_up", "EVL-1", sql(roll_up_sql(True) + "FROM per_domain", "per_domain"))
def _(spark, sf):
    return rounded(E.roll_up(E.per_domain(E.counts(paired(spark, sf), ALL))), *ROLL)


@query("multilabel_set_scores", "EVL-1 SET-4",
       sql(f"SELECT count(*) AS n, {rnd('avg(CASE WHEN bad = 0 THEN 1e0 ELSE 0e0 END)')} AS subset_accuracy, "
           f"{rnd('sum(off) / (count(*) * 19)')} AS hamming_loss FROM (SELECT report_id, sentence_idx, "
           "count(*) FILTER (in_g <> in_s) AS bad, count(*) FILTER (in_g <> in_s AND domain_id <> 'not_a_domain') AS off "
           "FROM status GROUP BY ALL)", "status"))
def _(spark, sf):
    return rounded(E.set_scores(paired(spark, sf), 19, ALL), "subset_accuracy", "hamming_loss")


@query("label_cooccurrence", "EVL-2 JN-12",
       sql("SELECT g.domain_id AS gold_id, s.domain_id AS silver_id, count(*) AS n FROM gold g JOIN silver s USING (report_id, sentence_idx) "
           "JOIN domains a ON a.id = g.domain_id JOIN domains b ON b.id = s.domain_id GROUP BY ALL", "gold", "silver", "domains"))
def _(spark, sf):
    return E.cooccurrence(paired(spark, sf), ALL)


@query("common_label_keys", "SET-1 JN-2", sql("SELECT * FROM common_keys", "common_keys"))
def _(spark, sf):
    g = X.gold_items(spark, sf).select(*L.KEYS)
    return g.intersect(X.silver_items(spark, sf).select(*L.KEYS))


# gold worksheet against rule labels, paired on trimmed text because indices may drift
cte("gold_text", "SELECT report_id, " + strip("sentence") + " AS txt, i.id AS domain_id, min(i.i) AS pos FROM sheet s JOIN sheet_ids i "
    "USING (doc_id, sentence_idx) WHERE report_id IS NOT NULL AND sentence IS NOT NULL GROUP BY ALL", "sheet", "sheet_ids")
cte("silver_text", "SELECT report_id, " + strip("sentence") + " AS txt, domain_id, 1 AS pos FROM sentences JOIN rule_labels "
    "USING (report_id, sentence_idx) GROUP BY ALL", "sentences", "rule_labels")
cte("text_keys", "SELECT DISTINCT report_id, txt FROM gold_text SEMI JOIN silver_text USING (report_id, txt)", "gold_text", "silver_text")
cte("text_status", "SELECT report_id, txt, domain_id, g.pos IS NOT NULL AS in_g, s.pos IS NOT NULL AS in_s FROM gold_text g FULL JOIN "
    "(SELECT * FROM silver_text SEMI JOIN text_keys USING (report_id, txt)) s USING (report_id, txt, domain_id)",
    "gold_text", "silver_text", "text_keys")
cte("text_per_domain", per_domain_sql("text_status"), "domains", "text_status")


def gold_text(spark, sf):
    g = L.parse_codes(L.worksheet_rows(sheet(spark, sf)).filter("report_id is not null and sentence is not null"))
    g = g.select("report_id", T.strip(F.col("sentence")).alias("txt"), "labels")
    return T.explode_rows(g, ["report_id", "txt"], "labels", ("pos", "domain_id"))


def silver_text(spark, sf):
    s = rule_labels(spark, sf).select("report_id", T.strip(F.col("sentence")).alias("txt"), "labels")
    return T.explode_rows(s, ["report_id", "txt"], "labels", ("pos", "domain_id"))


@query("sentence_level_agreement", "EVL-3 JN-3",
       sql(roll_up_sql(False) + ", CAST(max(n) AS BIGINT) AS n_sentences FROM text_per_domain, (SELECT count(*) AS n FROM text_keys)",
           "text_per_domain", "text_keys"))
def _(spark, sf):
    p = E.paired_sets(gold_text(spark, sf), silver_text(spark, sf), ["report_id", "txt"])
    p = materialise(p.select("gold", "silver"), "paired")       # counted and looked through
    r = E.roll_up(E.per_domain(E.counts(p, ALL), digits=None)).withColumn("_k", F.lit(1))
    n = p.agg(F.count("*").alias("n_sentences")).withColumn("_k", F.lit(1))
    return rounded(r.join(n, "_k").drop("_k"), *ROLL)


@query("unpaired_gold_text", "JN-3 SET-2",
       sql("SELECT report_id, md5(txt) AS digest FROM (SELECT DISTINCT report_id, txt FROM gold_text) g WHERE NOT EXISTS (SELECT 1 FROM "
           "gold_sel v WHERE v.report_id = g.report_id AND v.txt = g.txt)".replace("gold_sel", "(SELECT report_id, txt FROM silver_text "
           "WHERE domain_id <> 'other_general')"), "gold_text", "silver_text"))
def _(spark, sf):
    g = gold_text(spark, sf).select("report_id", "txt").distinct()
    s = silver_text(spark, sf).filter(F.col("domain_id") != ontology.FALLBACK)
    return g.join(s, ["report_id", "txt"], "left_anti").select("report_id", F.md5(F.encode("txt", "UTF-8")).alias("digest"))


cte("silver_primary", "SELECT report_id, sentence_idx, domain_id AS silver_id, confidence FROM silver s QUALIFY row_number() OVER "
    "(PARTITION BY report_id, sentence_idx ORDER BY confidence DESC, pos, domain_id) = 1", "silver")
cte("gold_primary", "SELECT report_id, sentence_idx, domain_id AS gold_id FROM gold QUALIFY row_number() OVER "
    "(PARTITION BY report_id, sentence_idx ORDER BY pos, domain_id) = 1", "gold")


def primaries(spark, sf):
    return E.primary(silver(spark, sf), L.KEYS).withColumnRenamed("primary_id", "silver_id")


@query("primary_label", "WIN-17", sql("SELECT report_id, sentence_idx, silver_id, confidence FROM silver_primary", "silver_primary"))
def _(spark, sf):
    return primaries(spark, sf)


@query("primary_confusion", "EVL-4 WIN-17",
       sql("SELECT gold_id, " + ", ".join(f"count(*) FILTER (silver_id = {lit(d)}) AS {d}" for d in ALL) +
           " FROM gold_primary JOIN silver_primary USING (report_id, sentence_idx) JOIN domains d ON d.id = gold_id GROUP BY 1",
           "gold_primary", "silver_primary", "domains"))
def _(spark, sf):
    g = gold(spark, sf).groupBy(*L.KEYS).agg(F.min_by("domain_id", "pos").alias("gold_id"))
    return E.confusion(g.join(primaries(spark, sf), L.KEYS), "gold_id", "silver_id", ALL)


# ---------------------------------------------------------------- vote reliability
cte("vote_primary", "SELECT v.report_id, v.sentence_idx, v.vote_no, coalesce(i.domain_id, '(none)') AS vote FROM votes v LEFT JOIN "
    "(SELECT * FROM vote_items QUALIFY row_number() OVER (PARTITION BY report_id, sentence_idx, vote_no ORDER BY confidence DESC, nth) = 1) i "
    "USING (report_id, sentence_idx, vote_no) WHERE v.error IS NULL", "votes", "vote_items")
cte("vote_counts", "SELECT report_id, sentence_idx, vote, count(*) AS c FROM vote_primary GROUP BY ALL", "vote_primary")
cte("vote_sentence", "SELECT report_id, sentence_idx, max(c) AS modal, sum(c) AS n, sum(c * c) AS sq, "
    "coalesce(sum(c) FILTER (vote <> '(none)'), 0) AS n_valid, max(c) FILTER (vote <> '(none)') AS modal_v FROM vote_counts GROUP BY ALL "
    "HAVING sum(c) = 5", "vote_counts")


def vote_table(spark, sf):
    return E.vote_table(E.vote_primaries(V.parse_votes(X.votes(spark, sf))))


@query("fleiss_kappa", "EVL-5",
       sql("SELECT n, " + rnd("o") + " AS observed, " + rnd("e") + " AS expected, " + rnd("(o - e) / (1 - e)") + " AS kappa FROM (SELECT count(*) AS n, "
           "avg((sq - 5) / 20.0) AS o FROM vote_sentence), (SELECT sum(p * p) AS e FROM (SELECT sum(c)::DOUBLE / sum(sum(c)) OVER () AS p FROM "
           "vote_counts SEMI JOIN vote_sentence USING (report_id, sentence_idx) GROUP BY vote))", "vote_sentence", "vote_counts"))
def _(spark, sf):
    return rounded(E.fleiss_kappa(vote_table(spark, sf), 20), "observed", "expected", "kappa")


MODAL = ("count(*) AS n, " + rnd("avg(modal) / 5") + " AS mean_modal, " + rnd("avg(modal_v / nullif(n_valid, 0))") + " AS mean_modal_valid, "
         + rnd("count(*) FILTER (modal = 5) / count(*)") + " AS unanimity, " + rnd("count(*) FILTER (modal IN (3, 4)) / count(*)") +
         " AS majority, " + rnd("count(*) FILTER (modal < 3) / count(*)") + " AS split")
MODAL_COLS = ["mean_modal", "mean_modal_valid", "unanimity", "majority", "split"]


@query("modal_agreement", "EVL-6", sql(f"SELECT {MODAL} FROM vote_sentence", "vote_sentence"))
def _(spark, sf):
    return rounded(E.modal_agreement(vote_table(spark, sf)), *MODAL_COLS)


@query("abstention_rate", "EVL-6",
       sql("SELECT count(*) AS n_votes, count(*) FILTER (vote = '(none)') AS n_none, " + rnd("count(*) FILTER (vote = '(none)') / count(*)") +
           " AS rate FROM vote_primary", "vote_primary"))
def _(spark, sf):
    p = E.vote_primaries(V.parse_votes(X.votes(spark, sf)))
    none = F.count_if(F.col("vote") == E.NONE)
    n = F.count("vote")
    return rounded(p.agg(n.alias("n_votes"), none.alias("n_none"), (none / n).alias("rate")), "rate")


@query("modal_agreement_by_domain", "EVL-7",
       sql("SELECT domain_id, n_conf, conf_mean, n, mean_modal, mean_modal_valid, unanimity, majority, split FROM (SELECT domain_id, "
           + rnd("avg(confidence)") + " AS conf_mean, count(*) AS n_conf, " + MODAL +
           " FROM vote_sentence JOIN voted USING (report_id, sentence_idx) WHERE pos = 0 GROUP BY 1)", "vote_sentence", "voted"))
def _(spark, sf):
    parsed = materialise(V.parse_votes(X.votes(spark, sf)), "parsed")       # both sides of the join read it
    top = V.consolidate(parsed).filter(F.size("labels") > 0).select(
        *L.KEYS, F.get("labels", F.lit(0))["domain_id"].alias("domain_id"), F.get("labels", F.lit(0))["confidence"].alias("confidence"))
    t = E.vote_table(E.vote_primaries(parsed)).join(top, L.KEYS).select("domain_id", "confidence", "modal", "modal_valid")
    t = materialise(t, "reliability")       # for the rates and for the confidence
    m = E.modal_agreement(t, ["domain_id"]).join(
        t.groupBy("domain_id").agg(F.avg("confidence").alias("conf_mean"), F.count("*").alias("n_conf")), "domain_id")
    return rounded(m, "conf_mean", *MODAL_COLS)


@query("votes_per_sentence", "AGG-22",
       sql("SELECT 'labels' AS what, n::BIGINT AS value, count(*) AS sentences FROM (SELECT count(*) AS n FROM voted GROUP BY report_id, sentence_idx) "
           "GROUP BY n UNION ALL SELECT 'valid', n_valid::BIGINT, count(*) FROM vote_sentence GROUP BY n_valid UNION ALL SELECT 'modal', modal::BIGINT, count(*) "
           "FROM vote_sentence GROUP BY modal", "voted", "vote_sentence"))
def _(spark, sf):
    parsed = materialise(V.parse_votes(X.votes(spark, sf)), "parsed")
    t = E.vote_table(E.vote_primaries(parsed))
    n = V.consolidate(parsed).filter("error is null").select(F.lit("labels").alias("what"), F.size("labels").cast("bigint").alias("value"))
    both = t.select(F.explode(F.array(F.struct(F.lit("valid").alias("what"), F.col("n_valid").alias("value")),
                                      F.struct(F.lit("modal").alias("what"), F.col("modal").alias("value")))).alias("s")).select("s.*")
    return n.unionByName(both).groupBy("what", "value").agg(F.count("*").alias("sentences"))


# ---------------------------------------------------------------- classification
PRED = ("r.report_id, substring(split_part(r.report_id, '-', -1), 1, 1) AS report_type, CAST(d.doc_id % 6 AS INT) AS fold, l.quality AS label, "
        "(d.n_chars % 1000) / 250e0 - 2 AS logit")
cte("predictions", f"SELECT {PRED} FROM labels l JOIN documents d USING (doc_id) JOIN reports r USING (doc_id)", "reports")
cte("probs", "SELECT *, 1 / (1 + exp(-logit)) AS prob, CAST(1 / (1 + exp(-logit)) >= 0.5 AS INT) AS predicted FROM predictions", "predictions")


def predictions(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = X.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    p = lab.join(d, "doc_id").withColumn("report_id", X.report_id())
    return p.select("report_id", T.report_type(F.col("report_id")).alias("report_type"), (F.col("doc_id") % 6).cast("int").alias("fold"),
                    "label", ((F.col("n_chars") % 1000) / 250 - 2).alias("logit"))


@query("predicted_labels", "EVL-12",
       sql(f"SELECT report_id, label, {rnd('prob', 10)} AS prob, predicted FROM probs", "probs"))
def _(spark, sf):
    return rounded(K.with_probability(predictions(spark, sf)).select("report_id", "label", "prob", "predicted"), "prob", digits=10)


BIN = ("count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp, "
       "count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 1 AND predicted = 0) AS fn")


@query("binary_metrics", "EVL-8",
       sql("SELECT report_type, fold, tp, fp, tn, fn, " + rnd("(tp + tn) / (tp + fp + tn + fn)") + " AS accuracy, "
           + rnd("coalesce(tp / nullif(tp + fp, 0), 0)") + " AS precision, " + rnd("coalesce(tp / nullif(tp + fn, 0), 0)") + " AS recall, "
           + rnd("coalesce(tn / nullif(tn + fp, 0), 0)") + " AS specificity, " + rnd("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)") +
           f" AS f1 FROM (SELECT coalesce(report_type, 'all') AS report_type, coalesce(fold, -1) AS fold, {BIN} FROM probs GROUP BY GROUPING SETS ((), (report_type), (fold))) "
           "WHERE fold <> 0", "probs"))
def _(spark, sf):
    c = K.confusion_counts(K.with_probability(predictions(spark, sf)), [[], ["report_type"], ["fold"]], ["report_type", "fold"])
    c = c.fillna({"report_type": "all", "fold": -1}).filter("fold <> 0")
    return rounded(K.metrics(c), "accuracy", "precision", "recall", "specificity", "f1")


cte("score_ranks", "SELECT *, rank() OVER (PARTITION BY fold ORDER BY logit) + (count(*) OVER (PARTITION BY fold, logit) - 1) / 2.0 AS rk FROM predictions",
    "predictions")
AUC = rnd("CASE WHEN np > 0 AND nn > 0 THEN (rs - np * (np + 1) / 2.0) / (np * nn) END")


@query("auroc_by_fold", "EVL-9 WIN-6",
       sql(f"SELECT fold, np + nn AS n, np AS n_pos, {AUC} AS auroc FROM (SELECT fold, count(*) FILTER (label = 1) AS np, "
           "count(*) FILTER (label = 0) AS nn, sum(rk) FILTER (label = 1) AS rs FROM score_ranks GROUP BY 1)", "score_ranks"))
def _(spark, sf):
    return rounded(R.auroc(predictions(spark, sf), "label", "logit", ["fold"]), "auroc")


LI_SCORE = ("SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, CAST(l_extendedprice AS DOUBLE) AS score, l_linestatus FROM lineitem")


def scored_items(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), F.col("l_extendedprice").alias("score"), "l_linestatus")


@query("auroc_of_items", "EVL-9",
       f"WITH s AS ({LI_SCORE}), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s) "
       f"SELECT np + nn AS n, np AS n_pos, {AUC} AS auroc FROM (SELECT count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn, "
       "sum(rk) FILTER (label = 1) AS rs FROM r)")
def _(spark, sf):
    return rounded(R.auroc(scored_items(spark, sf), "label", "score", buckets=64), "auroc")


cte("curve", "SELECT fold, logit AS threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS np, "
    "sum(neg) OVER (PARTITION BY fold) AS nn FROM (SELECT fold, logit, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY ALL) "
    "WINDOW w AS (PARTITION BY fold ORDER BY logit DESC)", "predictions")


@query("auprc_by_fold", "EVL-10",
       sql("SELECT fold, " + rnd("sum(pos / np * tp / (tp + fp))") + " AS auprc FROM curve GROUP BY 1", "curve"))
def _(spark, sf):
    return rounded(R.auprc(predictions(spark, sf), "label", "logit", ["fold"]), "auprc")


@query("roc_points", "EVL-11",
       sql(f"SELECT fold, {rnd('threshold')} AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, {rnd('tp / nullif(np, 0)')} AS tpr, "
           f"{rnd('fp / nullif(nn, 0)')} AS fpr FROM curve", "curve"))
def _(spark, sf):
    p = R.roc_points(predictions(spark, sf), "label", "logit", ["fold"])
    return rounded(p.select("fold", "threshold", "tp", "fp", "tpr", "fpr"), "threshold", "tpr", "fpr")
