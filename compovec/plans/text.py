"""Text preparation and keyword labeling over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from compovec.functions import text as T
from compovec.operators import rules as R
from compovec.operators import segment
from compovec.plans import fixtures as X
from compovec.plans.registry import query
from compovec.plans.rules import example_rules
from compovec.plans.sqlkit import (clean, cte, lit, pieces, rnd, shield_points, shield_spans, sql, strip)
from compovec.sources import ontology

WORD_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in T.WHITESPACE) + "]+"


@query("remove_headings", "TXT-1 FN-1",
       sql("SELECT page_id, " + strip("regexp_replace(regexp_replace(replace(html, '<h', '## <h'), '## [^#]+? ##', '', 'g'), "
           "' +', ' ', 'g')") + " AS body FROM pages"))
def _(spark, sf):
    p = X.table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("<h"), F.lit("## <h")).alias("html"))
    return p.select("page_id", T.remove_headings(F.col("html")).alias("body"))


@query("clean_text", "TXT-2 FN-1", sql(f"SELECT doc_id, {clean('text')} AS cleaned FROM documents"))
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query("shield_punctuation", "TXT-3",
       sql("SELECT doc_id, md5(t) AS shielded, length(t) AS n FROM shield3", "shield3"))
def _(spark, sf):
    d = X.reports(spark, sf).withColumn("t", T.clean_text(T.strip(F.col("text"))))
    for step in (T.shield_points, T.shield_quotes, T.shield_parentheses):
        d = d.withColumn("t", step(F.col("t")))
    return d.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("shielded"), F.length("t").cast("bigint").alias("n"))


@query("shield_punctuation_html", "TXT-3",
       sql(f"WITH a AS (SELECT page_id, {shield_points(clean('html'))} AS t FROM pages), "
           f"b AS (SELECT page_id, {shield_spans('t', T.QUOTED_SPAN)} AS t FROM a), "
           f"c AS (SELECT page_id, {shield_spans('t', T.PAREN_SPAN)} AS t FROM b) "
           f"SELECT page_id, md5(t) AS shielded, CAST(length(t) - length(translate(t, '{T.SHIELDED}', '')) AS BIGINT) "
           "AS n_hidden FROM c"))
def _(spark, sf):
    d = X.table(spark, sf, "pages").withColumn("t", T.clean_text(F.col("html")))
    for step in (T.shield_points, T.shield_quotes, T.shield_parentheses):
        d = d.withColumn("t", step(F.col("t")))
    hidden = F.length("t") - F.length(F.translate("t", T.SHIELDED, ""))
    return d.select("page_id", F.md5(F.encode("t", "UTF-8")).alias("shielded"), hidden.cast("bigint").alias("n_hidden"))


@query("split_pieces", "TXT-4",
       sql("SELECT doc_id, CAST(i - 1 AS INT) AS pos, piece FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i "
           f"FROM (SELECT doc_id, {pieces(clean('text'))} AS p FROM documents))"))
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("t"))
    return T.explode_rows(d, ["doc_id"], T.split_pieces(F.col("t")), ("pos", "piece"))


@query("merge_short_pieces", "TXT-5",
       sql("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INT) AS sentence_idx, "
           "string_agg(piece, ' ' ORDER BY i) AS merged FROM (SELECT *, sum(CASE WHEN i = 1 OR length(piece) > 30 THEN 1 ELSE 0 END) "
           "OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i "
           f"FROM (SELECT doc_id, {pieces(clean('text'))} AS p FROM documents))) GROUP BY doc_id, g"))
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", "text")
    return segment.segment_sentences(d, ["doc_id"], shield=False).withColumnRenamed("sentence", "merged")


@query("overlong_sentences", "TXT-6",
       sql("SELECT report_id, sentence_idx, sentence, length(sentence) AS n_chars FROM sentences WHERE length(sentence) > 500",
           "sentences"))
def _(spark, sf):
    return segment.overlong(X.sentences(spark, sf).drop("doc_id"))


@query("segment_sentences", "TXT-7", sql("SELECT report_id, sentence_idx, sentence FROM sentences", "sentences"))
def _(spark, sf):
    return X.sentences(spark, sf).drop("doc_id")


@query("first_sentences", "TXT-8",
       sql("SELECT report_id, sentence_idx, md5(sentence) AS digest FROM sentences WHERE sentence_idx < 64", "sentences"))
def _(spark, sf):
    s = segment.first_sentences(X.sentences(spark, sf), 64)
    return s.select("report_id", "sentence_idx", F.md5(F.encode("sentence", "UTF-8")).alias("digest"))


NTOK = f"len(list_filter(regexp_split_to_array(sentence, {lit(WORD_CLASS)}), lambda w: w <> ''))"


@query("valid_sentence_counts", "TXT-9",
       sql(f"SELECT report_id, count(*) FILTER ({NTOK} > 2) AS n_valid, count(*) AS n_sentences FROM sentences GROUP BY 1",
           "sentences"))
def _(spark, sf):
    return segment.valid_counts(X.sentences(spark, sf))


cte("words", f"SELECT doc_id, trim(w, {lit(T.PUNCTUATION)}) AS word FROM (SELECT doc_id, unnest(list_filter("
    f"regexp_split_to_array({strip('text')}, {lit(WORD_CLASS)}), lambda w: w <> '')) AS w FROM documents)")


@query("word_counts", "TXT-10", sql("SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM words GROUP BY 1", "words"))
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", "text")
    w = segment.explode_words(d, ["doc_id"], "text")
    # per-document counts first: the hottest word then arrives pre-aggregated
    per_doc = w.groupBy("word", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


@query("report_type_and_person", "TXT-11 TXT-12",
       sql("SELECT report_id, substring(split_part(report_id, '-', -1), 1, 1) AS report_type, "
           "regexp_replace(report_id, '(?:-[0-9]+)?-[AP][0-9]+$', '') AS person_id, substring(report_id, 1, 12) AS person_prefix "
           "FROM reports", "reports"))
def _(spark, sf):
    r = X.table(spark, sf, "documents").select(X.report_id().alias("report_id"))
    return r.select("report_id", T.report_type(F.col("report_id")).alias("report_type"),
                    T.person_id(F.col("report_id")).alias("person_id"),
                    F.substring("report_id", 1, 12).alias("person_prefix"))


@query("sentences_with_diagnosis", "TXT-13 JN-5",
       sql("SELECT s.report_id, s.sentence_idx, md5(s.sentence) AS digest, CAST(m.final_diag AS INT) AS label FROM sentences s "
           "JOIN metadata m ON m.code = s.report_id WHERE m.final_diag IS NOT NULL AND NOT isnan(m.final_diag)",
           "sentences", "metadata"))
def _(spark, sf):
    known = segment.with_diagnosis(X.reports(spark, sf), X.metadata(spark, sf))
    s = segment.segment_sentences(known, ["report_id", "label"])
    return s.select("report_id", "sentence_idx", F.md5(F.encode("sentence", "UTF-8")).alias("digest"), "label")


@query("annotation_worksheet", "LAB-20",
       sql("SELECT s.report_id, s.sentence_idx, md5(s.sentence) AS digest, '' AS domain_code FROM sentences s WHERE s.report_id IN "
           "(SELECT code FROM metadata)", "sentences", "metadata"))
def _(spark, sf):
    listed = X.metadata(spark, sf).select(F.col("code").alias("report_id"))
    rows, _missing = segment.worksheet(X.reports(spark, sf), listed)
    return rows.select("report_id", "sentence_idx", F.md5(F.encode("sentence", "UTF-8")).alias("digest"), "domain_code")


@query("worksheet_missing_reports", "LAB-20 SET-2",
       sql("SELECT DISTINCT r.report_id FROM (SELECT " + X.REPORT_ID.format(id="o_orderkey", half="(o_orderkey // 2)") +
           " AS report_id FROM orders) r WHERE r.report_id NOT IN (SELECT report_id FROM reports)", "reports"))
def _(spark, sf):
    listed = X.table(spark, sf, "orders").select(X.report_id("o_orderkey").alias("report_id"))
    return segment.worksheet(X.reports(spark, sf), listed)[1]


# ---------------------------------------------------------------- keyword rules
def _score_sql(domain: str) -> str:
    r = example_rules()
    return " + ".join(f"(CASE WHEN regexp_matches(sentence, {lit(p)}) THEN {w}::DOUBLE ELSE 0e0 END)"
                      for p, w in r.keywords[domain] + r.negative[domain])


def _rank_sql() -> str:
    pr = example_rules().priority
    return "(CASE " + " ".join(f"WHEN domain_id = {lit(d)} THEN {i}" for i, d in enumerate(pr)) + " ELSE 999 END)"


cte("rule_scores", "SELECT report_id, sentence_idx, sentence, unnest(" + X.IDS + ") AS domain_id, unnest([" +
    ", ".join(_score_sql(d) for d in ontology.ids()) + "]) AS score FROM sentences", "sentences")
cte("rule_ranked", "SELECT *, row_number() OVER (PARTITION BY report_id, sentence_idx ORDER BY score DESC, " + _rank_sql() +
    ") AS pos FROM rule_scores WHERE score >= 1", "rule_scores")
cte("rule_labels", "SELECT s.report_id, s.sentence_idx, coalesce(r.pos, 1) AS pos, coalesce(r.domain_id, 'other_general') AS domain_id "
    "FROM sentences s LEFT JOIN (SELECT * FROM rule_ranked WHERE pos <= 3) r USING (report_id, sentence_idx)",
    "sentences", "rule_ranked")


def rule_labels(spark, sf):
    return R.classify(X.sentences(spark, sf), example_rules())


@query("keyword_scores", "LAB-16",
       sql("SELECT report_id, sentence_idx, domain_id, score FROM rule_scores WHERE score <> 0", "rule_scores"))
def _(spark, sf):
    return R.explode_scores(X.sentences(spark, sf), example_rules(), ["report_id", "sentence_idx"])


@query("keyword_labels", "LAB-17",
       sql("SELECT report_id, sentence_idx, string_agg(domain_id, ',' ORDER BY pos) AS labels FROM rule_labels GROUP BY ALL",
           "rule_labels"))
def _(spark, sf):
    return rule_labels(spark, sf).select("report_id", "sentence_idx", F.array_join("labels", ",").alias("labels"))
