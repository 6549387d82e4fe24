"""Sentence importance, top-k selection and composition vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from compovec.operators import composition as C
from compovec.operators import importance as I
from compovec.operators import segment
from compovec.operators import votes as V
from compovec.plans import fixtures as X
from compovec.plans.labels import silver
from compovec.plans.registry import query
from compovec.plans.sqlkit import cte, lit, rnd, sql
from compovec.plans.text import NTOK, rule_labels
from compovec.sources import ontology

ALL, PILOT = ontology.ids(), ontology.ids(pilot=True)

cte("imp", "SELECT report_id, k AS sentence_idx, sum(w) AS importance FROM edges GROUP BY ALL", "edges")
cte("imp_rows", "SELECT report_id, q AS sentence_idx, sum(w) AS importance FROM edges GROUP BY ALL", "edges")
cte("ranked", "SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY importance DESC, sentence_idx) AS rank FROM imp", "imp")
cte("top10", "SELECT * FROM ranked WHERE rank <= 10", "ranked")
cte("valid_sentences", f"SELECT report_id, sentence_idx FROM sentences WHERE {NTOK} > 2", "sentences")
cte("pairs", "SELECT report_id, q, k, w / sum(w) OVER (PARTITION BY report_id, q) AS w FROM "
    "(SELECT report_id, q, k, sum(w) AS w FROM edges GROUP BY ALL)", "edges")


def rounded(df, *cols, digits=8):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits) + F.lit(0.0))
    return df


def top10(spark, sf):
    return I.top_k(I.importance(X.edges(spark, sf)), 10)


@query("sentence_importance", "WIN-1 SRC-6",
       sql("SELECT a.report_id, a.sentence_idx, a.importance AS received, b.importance AS given FROM imp a FULL JOIN imp_rows b "
           "USING (report_id, sentence_idx)".replace("a.report_id, a.sentence_idx", "report_id, sentence_idx"), "imp", "imp_rows"))
def _(spark, sf):
    e = X.edges(spark, sf)
    received = I.importance(e, "column_sum").withColumnRenamed("importance", "received")
    given = I.importance(e, "row_sum").withColumnRenamed("importance", "given")
    return received.join(given, C.KEYS, "full")


@query("top_sentences", "WIN-2",
       sql("SELECT report_id, CAST(rank AS INT) AS rank, sentence_idx, round(importance, 6) AS attention_score FROM top10", "top10"))
def _(spark, sf):
    return top10(spark, sf)


@query("top_valid_sentences", "WIN-2 SRC-6",
       sql("SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY importance DESC, sentence_idx) AS INT) AS rank, "
           "sentence_idx, round(importance, 6) AS attention_score FROM imp SEMI JOIN valid_sentences USING (report_id, sentence_idx) "
           "QUALIFY rank <= 5", "imp", "valid_sentences"))
def _(spark, sf):
    valid = segment.mark_valid(X.sentences(spark, sf)).filter("valid")
    return I.top_k(I.importance(X.edges(spark, sf), valid=valid), 5)


@query("edges_between_valid", "SRC-6 JN-8",
       sql("SELECT report_id, count(*) AS n_edges, sum(w) AS weight FROM edges e WHERE EXISTS (SELECT 1 FROM valid_sentences v WHERE "
           "v.report_id = e.report_id AND v.sentence_idx = e.q) AND EXISTS (SELECT 1 FROM valid_sentences v WHERE "
           "v.report_id = e.report_id AND v.sentence_idx = e.k) GROUP BY 1", "edges", "valid_sentences"))
def _(spark, sf):
    valid = segment.mark_valid(X.sentences(spark, sf)).filter("valid")
    e = I.restrict_to_valid(X.edges(spark, sf), valid)
    return e.groupBy("report_id").agg(F.count("*").alias("n_edges"), F.sum("w").alias("weight"))


@query("strong_pairs", "WIN-3", sql(f"SELECT report_id, q, k, {rnd('w', 9)} AS w FROM pairs WHERE w > 0.05", "pairs"))
def _(spark, sf):
    return rounded(I.strong_pairs(I.normalise_rows(X.edges(spark, sf))), "w", digits=9)


@query("peak_pair", "WIN-3",
       sql(f"SELECT report_id, {rnd('w', 9)} AS max_weight, q, k FROM pairs QUALIFY row_number() OVER (PARTITION BY report_id "
           "ORDER BY w DESC, q, k) = 1", "pairs"))
def _(spark, sf):
    return rounded(I.peak_pair(I.normalise_rows(X.edges(spark, sf))), "max_weight", digits=9)


@query("sentence_weight_profile", "WIN-3",
       sql(f"SELECT report_id, k AS sentence_idx, {rnd('sum(w)')} AS total_weight, {rnd('max(w)')} AS max_weight FROM pairs GROUP BY ALL",
           "pairs"))
def _(spark, sf):
    return rounded(I.sentence_profile(I.normalise_rows(X.edges(spark, sf))), "total_weight", "max_weight")


@query("most_attended_sentence", "WIN-4", sql("SELECT report_id, sentence_idx, importance FROM ranked WHERE rank = 1", "ranked"))
def _(spark, sf):
    return I.most_attended(I.importance(X.edges(spark, sf)))


# ---------------------------------------------------------------- composition
cte("rule_weighted", "SELECT report_id, sentence_idx, domain_id, 1e0 / count(*) OVER (PARTITION BY report_id, sentence_idx) AS w "
    "FROM rule_labels", "rule_labels")
cte("doc_mass", "SELECT report_id, domain_id, sum(w) AS mass FROM top10 JOIN rule_weighted USING (report_id, sentence_idx) GROUP BY ALL",
    "top10", "rule_weighted")
cte("doc_vectors", "SELECT r.report_id, d.ord, d.id AS domain_id, d.grp, coalesce(m.mass, 0e0) AS mass, "
    "coalesce(m.mass, 0e0) / sum(coalesce(m.mass, 0e0)) OVER (PARTITION BY r.report_id) AS prop FROM "
    "(SELECT DISTINCT report_id FROM top10) r CROSS JOIN domains d LEFT JOIN doc_mass m ON m.report_id = r.report_id "
    "AND m.domain_id = d.id", "top10", "domains", "doc_mass")


def doc_matched(spark, sf, active=ALL):
    return C.match(top10(spark, sf), C.from_ids(rule_labels(spark, sf)), active)


def doc_vectors(spark, sf, active=ALL):
    m = doc_matched(spark, sf, active)
    return C.proportions(C.dense(C.mass(m), active))


@query("document_composition", "AGG-4 AGG-5 AGG-6 AGG-7 JN-1 WIN-2",
       sql(f"SELECT report_id, ord, domain_id, {rnd('mass')} AS mass, {rnd('prop')} AS prop, CAST(mass > 0 AS INT) AS present "
           "FROM doc_vectors", "doc_vectors"))
def _(spark, sf):
    v = C.long(doc_vectors(spark, sf), ["mass", "prop", "present"], ALL)
    return rounded(v, "mass", "prop")


@query("composition_wide", "AGG-5 SNK-2",
       sql("PIVOT (SELECT report_id, domain_id, " + rnd("prop", 4) + " AS prop FROM doc_vectors) ON domain_id IN (" +
           ", ".join(lit(d) for d in ALL) + ") USING first(prop) GROUP BY report_id", "doc_vectors")
       .replace("PIVOT (SELECT", "SELECT * FROM (PIVOT (SELECT") + ")")
def _(spark, sf):
    # close the tie at the fifth digit the same way on both engines
    v = doc_vectors(spark, sf).withColumn("prop", F.transform("prop", lambda x: F.round(x, 4) + F.lit(0.0)))
    return C.wide(v, "prop", ALL, digits=None)


@query("composition_without_catch_all", "AGG-8",
       sql(f"SELECT report_id, domain_id, {rnd('coalesce(mass / nullif(sum(mass) OVER (PARTITION BY report_id), 0), 0)')} AS closed_after, "
           f"{rnd('prop')} AS closed_before FROM doc_vectors WHERE domain_id <> 'other_general'", "doc_vectors"))
def _(spark, sf):
    v = C.dense(C.mass(doc_matched(spark, sf)), ALL)
    at = C.other_position(ALL)
    names = [d for d in ALL if d != ontology.FALLBACK]
    v = v.withColumn("orig", F.col("mass"))
    after = C.proportions(v, drop=at, renormalise=True).withColumnRenamed("prop", "closed_after").drop("present")
    both = C.proportions(after.withColumn("mass", F.col("orig")), drop=at, renormalise=False).withColumnRenamed("prop", "closed_before")
    return rounded(C.long(both, ["closed_after", "closed_before"], names).drop("ord"), "closed_after", "closed_before")


# silver labels at table scale, split by confidence, with only the pilot domains active
cte("pilot_silver", "SELECT s.*, sum(confidence) OVER k AS total, count(*) OVER k AS m FROM silver s JOIN domains d ON d.id = s.domain_id "
    "AND d.pilot_active WINDOW k AS (PARTITION BY report_id, sentence_idx)", "silver", "domains")


@query("confidence_allocation", "AGG-4",
       sql(f"SELECT report_id, domain_id, {rnd('sum(CASE WHEN total > 0 THEN confidence / total ELSE 1e0 / m END)')} AS mass "
           "FROM pilot_silver GROUP BY ALL", "pilot_silver"))
def _(spark, sf):
    labels = C.nest(silver(spark, sf))
    m = C.match(labels.select(*C.KEYS), labels, PILOT)
    w = C.mass(m, "confidence").groupBy("report_id", "domain_id").agg(F.sum("w").alias("mass"))
    return rounded(w, "mass")


# selected sentences against the consolidated votes: failed sentences have no label row
cte("match_rows", "SELECT t.report_id, t.sentence_idx, t.rank, count(v.domain_id) AS nl, count(d.id) AS nm FROM top10 t LEFT JOIN voted v "
    "USING (report_id, sentence_idx) LEFT JOIN domains d ON d.id = v.domain_id AND d.pilot_active GROUP BY ALL",
    "top10", "voted", "domains")


def voted_match(spark, sf):
    voted = V.consolidate(V.parse_votes(X.votes(spark, sf))).filter("error is null")
    return C.match(top10(spark, sf), voted, PILOT)


@query("match_selected", "JN-1",
       sql("SELECT report_id, sentence_idx, CASE WHEN nl = 0 THEN 'no_label' WHEN nm = 0 THEN 'no_active_domain' ELSE 'matched' END "
           "AS status, nm AS n_mapped FROM match_rows", "match_rows"))
def _(spark, sf):
    m = voted_match(spark, sf)
    return m.select("report_id", "sentence_idx", "status", F.coalesce(F.when(F.size("mapped") > 0, F.size("mapped")), F.lit(0)).cast("bigint").alias("n_mapped"))


@query("match_statistics", "AGG-9 SNK-4",
       sql("SELECT count(*) AS total_selected, count(*) FILTER (nm > 0) AS matched, count(*) FILTER (nl = 0) AS no_label, "
           "count(*) FILTER (nl > 0 AND nm = 0) AS no_active_domain, sum(nm)::BIGINT AS assignments, sum(nl - nm)::BIGINT AS discarded, "
           + rnd("count(*) FILTER (nm > 0) / count(*)") + " AS match_rate FROM match_rows", "match_rows"))
def _(spark, sf):
    return rounded(C.statistics(voted_match(spark, sf)), "match_rate")


@query("match_details", "AGG-10 SNK-4",
       sql("SELECT m.report_id, count(DISTINCT m.sentence_idx) AS n_selected, count(DISTINCT m.sentence_idx) FILTER (nm > 0) AS n_matched, "
           "coalesce(string_agg(d.id, ',' ORDER BY m.rank, v.pos) , '') AS domains_found FROM match_rows m LEFT JOIN voted v "
           "USING (report_id, sentence_idx) LEFT JOIN domains d ON d.id = v.domain_id AND d.pilot_active GROUP BY 1",
           "match_rows", "voted", "domains"))
def _(spark, sf):
    d = C.details(voted_match(spark, sf))
    return d.withColumn("domains_found", F.array_join("domains_found", ","))


@query("hit_vectors", "AGG-14",
       sql(f"SELECT report_id, domain_id, {rnd('n / sum(n) OVER (PARTITION BY report_id)')} AS prop FROM (SELECT report_id, domain_id, "
           "count(*) AS n FROM match_rows JOIN voted USING (report_id, sentence_idx) JOIN domains d ON d.id = domain_id AND d.pilot_active "
           "GROUP BY ALL)", "match_rows", "voted", "domains"))
def _(spark, sf):
    h = C.hit_vector(C.details(voted_match(spark, sf)), PILOT)
    return rounded(C.long(h, ["prop"], PILOT).drop("ord").filter("prop > 0"), "prop")


@query("mean_composition", "AGG-11",
       sql("SELECT domain_id, " + rnd("avg(prop)") + " AS mean, row_number() OVER (ORDER BY round(avg(prop), 10) DESC, domain_id) AS place "
           "FROM doc_vectors GROUP BY 1 ORDER BY place LIMIT 6", "doc_vectors"))
def _(spark, sf):
    # the mean table has one row per domain, so ranking it is a driver-sized step
    m = C.prototype(C.long(doc_vectors(spark, sf), ["prop"], ALL)).select("domain_id", F.round("mean", 10).alias("mean"))
    top = m.orderBy(F.desc("mean"), "domain_id").limit(6)
    place = F.row_number().over(Window.orderBy(F.desc("mean"), "domain_id"))
    return rounded(top.withColumn("place", place.cast("bigint")), "mean")


@query("mean_composition_by_type", "AGG-11",
       sql("SELECT report_type, domain_id, " + rnd("avg(prop)") + " AS mean, count(*) AS n FROM (SELECT *, "
           "substring(split_part(report_id, '-', -1), 1, 1) AS report_type FROM doc_vectors) GROUP BY ALL", "doc_vectors"))
def _(spark, sf):
    from compovec.functions.text import report_type
    v = doc_vectors(spark, sf).withColumn("report_type", report_type(F.col("report_id")))
    return rounded(C.prototype(C.long(v, ["prop"], ALL, ["report_id", "report_type"]), by=["report_type"]), "mean")
