"""Example inputs derived from the given tables, the same way on both engines.

Formulas use integer arithmetic, concatenation and md5 only, written once as SQL
text that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compovec.operators import segment
from compovec.plans.sqlkit import IDS, clean, cte, pieces, shield_points, shield_spans, strip
from compovec.functions import text as T
from compovec.session import spread
from compovec.sources import ontology

N_DOMAINS = len(ontology.ids())


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- reports and sentences
REPORT_ID = ("'PER-' || lpad(cast({half} as string), 12, '0') || '-' || "
             "CASE WHEN {id} % 2 = 0 THEN '1-A01' ELSE '2-P01' END")


def report_id(col: str = "doc_id"):
    return F.expr(REPORT_ID.format(id=col, half=f"({col} div 2)"))


cte("reports", "SELECT doc_id, " + REPORT_ID.format(id="doc_id", half="(doc_id // 2)") +
    " AS report_id, text FROM documents")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", report_id().alias("report_id"), "text")


cte("cleaned", f"SELECT doc_id, report_id, {clean(strip('text'))} AS t FROM reports", "reports")
cte("shield1", f"SELECT doc_id, report_id, {shield_points('t')} AS t FROM cleaned", "cleaned")
cte("shield2", f"SELECT doc_id, report_id, {shield_spans('t', T.QUOTED_SPAN)} AS t FROM shield1", "shield1")
cte("shield3", f"SELECT doc_id, report_id, {shield_spans('t', T.PAREN_SPAN)} AS t FROM shield2", "shield2")
cte("pieces", f"SELECT doc_id, report_id, {pieces('t')} AS p FROM shield3", "shield3")
cte("starts", f"SELECT *, list_filter(list_transform(p, lambda x, i: CASE WHEN i = 1 OR length(x) > {T.MIN_LENGTH} "
    "THEN i END), lambda i: i IS NOT NULL) AS s FROM pieces", "pieces")
cte("sentence_lists", "SELECT doc_id, report_id, list_transform(s, lambda a, j: translate(array_to_string("
    f"p[a : coalesce(s[j + 1], len(p) + 1) - 1], ' '), '{T.SHIELDED}', '{T.TERMINATORS}')) AS l FROM starts", "starts")
cte("sentences", "SELECT doc_id, report_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS sentence_idx, "
    "unnest(l) AS sentence FROM sentence_lists", "sentence_lists")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return segment.segment_sentences(reports(spark, sf), ["doc_id", "report_id"])


# ---------------------------------------------------------------- metadata
# quality is the known diagnosis; every eleventh score turns it into NaN, and
# documents without a label have no metadata row at all
cte("metadata", "SELECT r.report_id AS code, CASE WHEN l.doc_id % 11 = 3 THEN CAST('NaN' AS DOUBLE) "
    "ELSE CAST(l.quality AS DOUBLE) END AS final_diag FROM labels l JOIN reports r ON r.doc_id = l.doc_id", "reports")


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    diag = F.expr("CASE WHEN doc_id % 11 = 3 THEN CAST('NaN' AS DOUBLE) ELSE CAST(quality AS DOUBLE) END")
    return lab.select(report_id().alias("code"), diag.alias("final_diag"))


# ---------------------------------------------------------------- sentence weights
# Every sentence points to four others of its document: a sparse weight table
# whose size is linear in the text.
EDGE_K = "(sentence_idx * (j + 1) + doc_id + j) % n"
EDGE_W = "CAST((doc_id * 7 + sentence_idx * 31 + k * 17 + length(sentence)) % 97 + 1 AS DOUBLE)"

cte("edges", f"SELECT report_id, sentence_idx AS q, CAST(k AS INT) AS k, {EDGE_W} AS w FROM (SELECT *, {EDGE_K} AS k FROM "
    "(SELECT s.*, c.n, j FROM sentences s JOIN (SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id) c "
    "USING (doc_id), (VALUES (0), (1), (2), (3)) v(j)))", "sentences")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    arr = segment.segment_array(reports(spark, sf))
    rows = T.explode_rows(arr.withColumn("n", F.size("sentences")), ["doc_id", "report_id", "n"], "sentences",
                          ("sentence_idx", "sentence"))
    rows = rows.withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    rows = rows.withColumn("k", F.expr(EDGE_K))
    return rows.select("report_id", F.col("sentence_idx").alias("q"), F.col("k").cast("int").alias("k"),
                       F.expr(EDGE_W).alias("w"))


# ---------------------------------------------------------------- votes
def _domain(expr: str, engine: str) -> str:
    if engine == "spark":
        items = ",".join(f"'{i}'" for i in ontology.ids())
        return f"element_at(array({items}), CAST(({expr}) % {N_DOMAINS} AS INT) + 1)"
    return f"{IDS}[CAST(({expr}) % {N_DOMAINS} AS INT) + 1]"


def _conf(expr: str) -> str:
    return f"(CASE WHEN ({expr}) % 11 = 10 THEN '1.0' ELSE '0.' || CAST(({expr}) % 11 AS STRING) END)"


def vote_columns(engine: str) -> dict[str, str]:
    d1 = _domain("doc_id * 7 + sentence_idx * 13 + vote_no * (sentence_idx % 3)", engine)
    d2 = _domain("doc_id * 7 + sentence_idx * 13 + vote_no % 2 + 1", engine)
    d3 = _domain("doc_id + sentence_idx * 5 + 3", engine)
    c1, c2, c3 = (_conf("doc_id + sentence_idx + vote_no"), _conf("doc_id + sentence_idx * 2 + 7"),
                  _conf("doc_id * 3 + sentence_idx + 8"))

    def item(d, c, why):
        return ("'{\"domain_id\": \"' || " + d + " || '\", \"confidence\": ' || " + c +
                " || ', \"rationale\": \"" + why + "' || CAST(vote_no AS STRING) || '\"}'")

    a, b, c = item(d1, c1, "r"), item(d2, c2, "because "), item(d3, c3, "x")
    nl = "chr(10)"
    bare = f"'{{\"labels\": [' || {a} || ', ' || {b} || ', ' || {c} || ']}}'"
    style = "(doc_id + sentence_idx + vote_no) % 9"
    text = (
        "CASE " +
        f"WHEN {style} = 1 THEN 'Answer:' || {nl} || '```json' || {nl} || {bare} || {nl} || '```' || {nl} "
        f"WHEN {style} = 2 THEN '{{\"labels\": [' || {a} || ', ' || {b} || ', ]}}' "
        f"WHEN {style} = 3 THEN '{{\"labels\": [' || {b} || ', ' || {a} "
        f"WHEN {style} = 4 THEN 'Label: {{\"label\": ' || {a} || '}} done' "
        f"WHEN {style} = 5 THEN '{{\"labels\": [{{\"domain_id\": \"unknown\", \"confidence\": 1}}, ' || {a} || ', ' || "
        f"replace({a}, '\"confidence\": ', '\"confidence\": 1') || ', \"text\", ' || {b} || ']}}' "
        f"WHEN {style} = 6 THEN '{{\"labels\": [' || {a} || ', {{\"domain_id\": \"' || {d2} || '\", \"confidence\": null}}, "
        f"{{\"domain_id\": \"' || {d3} || '\", \"confidence\": \"0.9\"}}, {{\"domain_id\": \"' || {d2} || "
        f"'\", \"confidence\": \"high\"}}]}}' "
        f"WHEN {style} = 7 THEN 'no answer ' || CAST(vote_no AS STRING) "
        f"ELSE {bare} END"
    )
    failed = "(doc_id + sentence_idx * 3 + vote_no) % 53 = 0"
    return {"response_text": f"CASE WHEN {failed} THEN NULL ELSE {text} END",
            "error": f"CASE WHEN {failed} THEN 'call ' || CAST(vote_no AS STRING) || ' timed out' END"}


_v = vote_columns("sql")
cte("votes", f"SELECT report_id, sentence_idx, vote_no, {_v['response_text']} AS response_text, {_v['error']} AS error "
    "FROM sentences, (VALUES (0), (1), (2), (3), (4)) v(vote_no)", "sentences")


def votes(spark: SparkSession, sf: str) -> DataFrame:
    s = sentences(spark, sf).withColumn("vote_no", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    v = vote_columns("spark")
    return s.select("report_id", "sentence_idx", "vote_no", F.expr(v["response_text"]).alias("response_text"),
                    F.expr(v["error"]).alias("error"))


# ---------------------------------------------------------------- label items at table scale
# One lineitem row is one label item of sentence (order, line number); keys repeat.
LI_REPORT = REPORT_ID
SILVER_ORD = "l_suppkey % 20"          # ordinal 19 is a domain outside the ontology
GOLD_ORD = "CASE WHEN l_quantity <= 30 THEN l_suppkey % 19 ELSE l_partkey % 19 END"
SILVER_CONF = "CASE WHEN l_quantity = 7 THEN NULL ELSE l_discount * 10 END"
LI_POS = "l_partkey * 100 + CAST(l_quantity AS BIGINT)"


def _li_domain(ord_expr: str, engine: str) -> str:
    known = _domain(ord_expr, engine)
    return f"CASE WHEN ({ord_expr}) < {N_DOMAINS} THEN {known} ELSE 'not_a_domain' END"


cte("silver_items", "SELECT " + LI_REPORT.format(id="l_orderkey", half="(l_orderkey // 2)") + " AS report_id, "
    f"l_linenumber AS sentence_idx, {LI_POS} AS pos, {_li_domain(SILVER_ORD, 'sql')} AS domain_id, "
    f"{SILVER_CONF} AS confidence FROM lineitem")
cte("gold_items", "SELECT " + LI_REPORT.format(id="l_orderkey", half="(l_orderkey // 2)") + " AS report_id, "
    f"l_linenumber AS sentence_idx, {LI_POS} AS pos, {_li_domain(GOLD_ORD, 'sql')} AS domain_id FROM lineitem "
    "WHERE l_returnflag <> 'N'")


def silver_items(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.expr(LI_REPORT.format(id="l_orderkey", half="(l_orderkey div 2)")).alias("report_id"),
        F.col("l_linenumber").alias("sentence_idx"), F.expr(LI_POS).alias("pos"),
        F.expr(_li_domain(SILVER_ORD, "spark")).alias("domain_id"), F.expr(SILVER_CONF).alias("confidence"))


def gold_items(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").filter("l_returnflag <> 'N'")
    return li.select(
        F.expr(LI_REPORT.format(id="l_orderkey", half="(l_orderkey div 2)")).alias("report_id"),
        F.col("l_linenumber").alias("sentence_idx"), F.expr(LI_POS).alias("pos"),
        F.expr(_li_domain(GOLD_ORD, "spark")).alias("domain_id"))
