"""Responses, votes, gold worksheets and code translation."""

from __future__ import annotations

from pyspark.sql import functions as F

from compovec.functions import responses as J
from compovec.operators import labels as L
from compovec.operators import votes as V
from compovec.plans import fixtures as X
from compovec.plans.registry import query
from compovec.plans.sqlkit import WS, cte, lit, rnd, sql, strip
from compovec.sources import ontology

cte("raw_json", "SELECT *, CASE WHEN regexp_matches(response_text, '" + J.FENCE + "') THEN "
    + strip(f"regexp_extract(response_text, '{J.FENCE}', 1)") +
    " WHEN strpos(response_text, '{') > 0 AND strpos(response_text, '}') > 0 AND "
    "length(response_text) - strpos(reverse(response_text), '}') + 1 >= strpos(response_text, '{') "
    "THEN response_text[strpos(response_text, '{') : length(response_text) - strpos(reverse(response_text), '}') + 1] "
    "ELSE " + strip("response_text") + " END AS raw FROM votes", "votes")
cte("trimmed_json", "SELECT * EXCLUDE raw, regexp_replace(" + strip("raw") + ", ',\\s*([}\\]])', '\\1', 'g') AS raw FROM raw_json",
    "raw_json")
cte("fixed_json", "SELECT * EXCLUDE (raw, closed), CASE WHEN json_valid(raw) THEN raw WHEN json_valid(closed) THEN closed END AS fixed FROM "
    "(SELECT *, raw || list_reduce(string_split(regexp_replace(raw, '[^\\[\\]{}]', '', 'g'), ''), "
    "lambda st, ch: CASE WHEN ch = '{' THEN '}' || st WHEN ch = '[' THEN ']' || st "
    "WHEN ch <> '' AND st[1:1] = ch THEN st[2:] ELSE st END, '') AS closed FROM trimmed_json)", "trimmed_json")
cte("raw_items", "SELECT report_id, sentence_idx, vote_no, i - 1 AS raw_pos, json_extract(fixed, CASE WHEN json_type(fixed, '$.labels') "
    "= 'ARRAY' THEN '$.labels[' || (i - 1) || ']' ELSE '$.label' END) AS item FROM (SELECT *, unnest(generate_series(1, CASE WHEN "
    "json_type(fixed, '$.labels') = 'ARRAY' THEN json_array_length(fixed, '$.labels')::BIGINT WHEN json_type(fixed, '$.label') = "
    "'OBJECT' THEN 1::BIGINT ELSE 0::BIGINT END)) AS i FROM fixed_json)", "fixed_json")
cte("items", "SELECT *, row_number() OVER (PARTITION BY report_id, sentence_idx, vote_no ORDER BY raw_pos) AS nth FROM ("
    "SELECT r.report_id, r.sentence_idx, r.vote_no, r.raw_pos, d.id AS domain_id, d.code AS domain_code, "
    "greatest(0e0, least(1e0, CASE WHEN json_type(item, '$.confidence') IS NULL THEN 0e0 ELSE "
    "TRY_CAST(json_extract_string(item, '$.confidence') AS DOUBLE) END)) AS confidence, "
    "coalesce(json_extract_string(item, '$.rationale'), '') AS rationale, "
    "CASE WHEN json_type(item, '$.confidence') IS NULL THEN 0e0 ELSE TRY_CAST(json_extract_string(item, '$.confidence') AS DOUBLE) END AS c0 "
    "FROM raw_items r JOIN domains d ON d.id = " + strip("json_extract_string(item, '$.domain_id')") +
    " WHERE json_type(item) = 'OBJECT') WHERE c0 IS NOT NULL", "raw_items", "domains")
cte("vote_items", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id, sentence_idx, vote_no, domain_id "
    "ORDER BY nth) AS occ FROM items) WHERE occ = 1", "items")
cte("vote_agg", "SELECT report_id, sentence_idx, domain_id, max(domain_code) AS domain_code, count(*) AS votes, "
    "round(avg(confidence), 12) AS mean, min(vote_no * 1000 + nth) AS seen, "
    "arg_max(rationale, length(rationale) * 100 - vote_no) AS rationale FROM vote_items GROUP BY ALL", "vote_items")
cte("vote_failed", "SELECT report_id, sentence_idx, arg_min(error, vote_no) AS error, count(*) AS n_failed FROM votes WHERE error IS NOT NULL "
    "GROUP BY ALL", "votes")
cte("winners", "SELECT *, row_number() OVER (PARTITION BY report_id, sentence_idx ORDER BY round(mean, 3) DESC, seen) AS pos FROM vote_agg "
    "WHERE votes / 5.0 >= 0.5 AND mean >= 0.5", "vote_agg")
cte("voted", "SELECT s.report_id, s.sentence_idx, coalesce(w.pos, 1) - 1 AS pos, coalesce(w.domain_id, 'other_general') AS domain_id, "
    "coalesce(w.domain_code, 'RE2') AS domain_code, "
    "CASE WHEN w.domain_id IS NULL THEN coalesce(round(round(a.mean_all, 12), 3), 0e0) ELSE round(w.mean, 3) END AS confidence, "
    "CASE WHEN w.domain_id IS NULL THEN 'Below threshold; using fallback' ELSE w.rationale END AS rationale "
    "FROM (SELECT DISTINCT report_id, sentence_idx FROM votes) s ANTI JOIN vote_failed f USING (report_id, sentence_idx) "
    "LEFT JOIN (SELECT * FROM winners WHERE pos <= 3) w USING (report_id, sentence_idx) "
    "LEFT JOIN (SELECT report_id, sentence_idx, avg(confidence) AS mean_all FROM vote_items GROUP BY ALL) a "
    "USING (report_id, sentence_idx)", "votes", "vote_failed", "winners", "vote_items")


@query("extract_response_json", "LAB-1 FN-6", sql("SELECT report_id, sentence_idx, vote_no, raw FROM raw_json", "raw_json"))
def _(spark, sf):
    return X.votes(spark, sf).select("report_id", "sentence_idx", "vote_no",
                                     J.extract_json(F.col("response_text")).alias("raw"))


@query("repair_response_json", "LAB-2 FN-6", sql("SELECT report_id, sentence_idx, vote_no, fixed FROM fixed_json", "fixed_json"))
def _(spark, sf):
    v = X.votes(spark, sf).withColumn("raw", J.extract_json(F.col("response_text")))
    return v.select("report_id", "sentence_idx", "vote_no", J.repair_json(F.col("raw")).alias("fixed"))


@query("normalise_response_items", "LAB-3 LAB-4 LAB-5",
       sql("SELECT report_id, sentence_idx, vote_no, domain_id, domain_code, confidence, rationale FROM vote_items", "vote_items"))
def _(spark, sf):
    return V.explode_items(V.parse_votes(X.votes(spark, sf))).drop("item_pos")


@query("consolidate_votes", "LAB-6 LAB-7 LAB-8",
       sql("SELECT report_id, sentence_idx, CAST(pos AS INT) AS pos, domain_id, domain_code, confidence, rationale FROM voted", "voted"))
def _(spark, sf):
    return V.label_rows(V.consolidate(V.parse_votes(X.votes(spark, sf))))


@query("failed_sentences", "LAB-9", sql("SELECT * FROM vote_failed", "vote_failed"))
def _(spark, sf):
    return V.failures(X.votes(spark, sf))


@query("consolidation_errors", "LAB-9",
       sql("SELECT count(*) AS n_sentences, (SELECT count(*) FROM vote_failed) AS n_failed FROM "
           "(SELECT DISTINCT report_id, sentence_idx FROM votes)", "votes", "vote_failed"))
def _(spark, sf):
    c = V.consolidate(V.parse_votes(X.votes(spark, sf)))
    return c.agg(F.count("*").alias("n_sentences"), F.count("error").alias("n_failed"))


@query("remaining_sentences", "LAB-10 JN-9 SET-2",
       sql("SELECT report_id, sentence_idx FROM (SELECT DISTINCT report_id, sentence_idx FROM silver_items) a WHERE NOT EXISTS "
           "(SELECT 1 FROM gold_items g WHERE g.report_id = a.report_id AND g.sentence_idx = a.sentence_idx)",
           "silver_items", "gold_items"))
def _(spark, sf):
    todo = X.silver_items(spark, sf).select(*V.KEYS).distinct()
    return V.remaining(todo, X.gold_items(spark, sf))


@query("first_reports_by_name", "LAB-11 WIN-19",
       sql("SELECT report_id, length(text) AS n_chars FROM reports ORDER BY report_id LIMIT 25", "reports"))
def _(spark, sf):
    r = V.restrict(X.reports(spark, sf), first_n=25)
    return r.select("report_id", F.length("text").alias("n_chars"))


@query("named_reports", "LAB-11",
       sql("SELECT report_id, length(text) AS n_chars FROM reports WHERE report_id IN ('PER-000000000001-1-A01', "
           "'PER-000000000003-2-P01', 'PER-missing')", "reports"))
def _(spark, sf):
    names = ["PER-000000000001-1-A01", "PER-000000000003-2-P01", "PER-missing"]
    return V.restrict(X.reports(spark, sf), names=names).select("report_id", F.length("text").alias("n_chars"))


# tokens as they occur in worksheets: code, lower-case code, id, unknown
TOKEN = ("CASE WHEN l_partkey % 4 = 0 THEN {code} WHEN l_partkey % 4 = 1 THEN lower({code}) "
         "WHEN l_partkey % 4 = 2 THEN {id} ELSE 'Z' || CAST(l_partkey % 7 AS STRING) END")


def _code(expr: str, engine: str) -> str:
    if engine == "spark":
        return f"element_at(array({','.join(lit(c) for c in ontology.codes())}), CAST(({expr}) % 19 AS INT) + 1)"
    return f"[{','.join(lit(c) for c in ontology.codes())}][CAST(({expr}) % 19 AS INT) + 1]"


cte("tokens", "SELECT l_orderkey, l_linenumber, l_partkey, " + TOKEN.format(code=_code("l_suppkey", "sql"), id=X._domain("l_suppkey", "sql")) +
    " AS token FROM lineitem")


def tokens(spark, sf):
    e = TOKEN.format(code=_code("l_suppkey", "spark"), id=X._domain("l_suppkey", "spark"))
    return X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(e).alias("token"))


@query("translate_codes", "LAB-12 FN-5",
       sql("SELECT t.*, coalesce(c.id, i.id, t.token) AS passed, coalesce(c.id, i.id) AS known FROM tokens t "
           "LEFT JOIN domains c ON c.code = t.token LEFT JOIN domains i ON i.id = t.token", "tokens", "domains"))
def _(spark, sf):
    t = tokens(spark, sf)
    t = L.translate(t, "token", keep_unknown=True).withColumnRenamed("domain_id", "passed")
    return L.translate(t, "token", keep_unknown=False).withColumnRenamed("domain_id", "known")


@query("code_list_translation", "LAB-12 FN-4",
       sql("SELECT report_id, sentence_idx, string_agg(d.code, ',' ORDER BY d.code) AS codes, count(*) AS n FROM "
           "(SELECT DISTINCT report_id, sentence_idx, domain_id FROM silver_items) s JOIN domains d ON d.id = s.domain_id GROUP BY ALL",
           "silver_items", "domains"))
def _(spark, sf):
    ids = X.silver_items(spark, sf).groupBy(*L.KEYS).agg(F.collect_set("domain_id").alias("ids"))
    c = L.to_codes(ids, "ids").filter(F.size("codes") > 0)
    return c.select(*L.KEYS, F.array_join(F.array_sort("codes"), ",").alias("codes"), F.size("codes").cast("bigint").alias("n"))


@query("natural_code_order", "LAB-13",
       sql("SELECT token, n, CASE WHEN token = '' THEN 'Z' ELSE regexp_replace(token, '[0-9]', '', 'g') END AS prefix, "
           "CASE WHEN token = '' THEN 999 ELSE coalesce(TRY_CAST(regexp_replace(token, '[^0-9]', '', 'g') AS INT), 0) END AS number "
           "FROM (SELECT token, count(*) AS n FROM tokens GROUP BY 1) ORDER BY 3, 4", "tokens"))
def _(spark, sf):
    t = tokens(spark, sf).groupBy("token").agg(F.count("*").alias("n"))
    prefix, number = ontology.code_sort_key(F.col("token"))
    return t.withColumn("prefix", prefix).withColumn("number", number).orderBy("prefix", "number")


# gold worksheet over every sentence: comma lists, blanks, unknown tokens, missing cells
SHEET = {
    "report_id": "CASE WHEN (doc_id + sentence_idx) % 10 = 9 THEN NULL ELSE report_id END",
    "sentence": "CASE WHEN (doc_id + sentence_idx * 3) % 10 = 9 THEN NULL ELSE sentence END",
    "domain_code": "CASE WHEN sentence_idx % 9 = 0 THEN NULL WHEN sentence_idx % 9 = 1 THEN '  ' ELSE {c1} || "
                   "CASE WHEN sentence_idx % 4 = 0 THEN ' , ' || lower({c2}) ELSE '' END || "
                   "CASE WHEN sentence_idx % 5 = 0 THEN ',' || {id} || ',' ELSE '' END || "
                   "CASE WHEN sentence_idx % 7 = 0 THEN ', ZZ9' ELSE '' END END",
}


def _sheet(engine: str) -> dict[str, str]:
    f = {"c1": _code("doc_id * 7 + sentence_idx * 13", engine), "c2": _code("doc_id + sentence_idx", engine),
         "id": X._domain("doc_id * 7 + sentence_idx * 13", engine)}
    return {k: v.format(**f) for k, v in SHEET.items()}


cte("sheet", "SELECT doc_id, sentence_idx, " + ", ".join(f"{v} AS {k}" for k, v in _sheet("sql").items()) + " FROM sentences", "sentences")


def sheet(spark, sf):
    return X.sentences(spark, sf).select("doc_id", "sentence_idx", *[F.expr(v).alias(k) for k, v in _sheet("spark").items()])


cte("sheet_tokens", "SELECT *, " + strip("raw") + " AS token FROM (SELECT doc_id, sentence_idx, unnest(string_split(domain_code, ',')) "
    "AS raw, generate_subscripts(string_split(domain_code, ','), 1) AS i FROM sheet WHERE domain_code IS NOT NULL "
    "AND (report_id IS NOT NULL OR sentence IS NOT NULL)) WHERE " + strip("raw") + " <> ''", "sheet")
cte("sheet_ids", "SELECT doc_id, sentence_idx, d.id, min(i) AS i FROM sheet_tokens t JOIN domains d ON t.token = d.id OR "
    "upper(t.token) = d.code GROUP BY ALL", "sheet_tokens", "domains")


@query("worksheet_rows", "SRC-7",
       sql("SELECT doc_id, sentence_idx, report_id, md5(sentence) AS digest FROM sheet WHERE report_id IS NOT NULL OR sentence IS NOT NULL",
           "sheet"))
def _(spark, sf):
    return L.worksheet_rows(sheet(spark, sf)).select(
        "doc_id", "sentence_idx", "report_id", F.md5(F.encode("sentence", "UTF-8")).alias("digest"))


@query("parse_code_cells", "LAB-14",
       sql("SELECT doc_id, sentence_idx, string_agg(id, ',' ORDER BY i) AS labels FROM sheet_ids GROUP BY ALL", "sheet_ids"))
def _(spark, sf):
    p = L.parse_codes(L.worksheet_rows(sheet(spark, sf)))
    return p.filter(F.size("labels") > 0).select("doc_id", "sentence_idx", F.array_join("labels", ",").alias("labels"))


@query("unknown_code_tokens", "LAB-14 SET-2",
       sql("SELECT doc_id, sentence_idx, token FROM sheet_tokens t WHERE NOT EXISTS (SELECT 1 FROM domains d WHERE t.token = d.id OR "
           "upper(t.token) = d.code)", "sheet_tokens", "domains"))
def _(spark, sf):
    p = L.parse_codes(L.worksheet_rows(sheet(spark, sf)))
    return L.explode_rows(p, ["doc_id", "sentence_idx"], "unknown", ("pos", "token")).drop("pos")


@query("numeric_code_cells", "LAB-14",
       "SELECT l_orderkey, l_linenumber, '' AS labels, CAST(trunc(l_quantity + l_discount) AS BIGINT)::VARCHAR AS unknown FROM lineitem WHERE l_linenumber > 1")
def _(spark, sf):
    """Cells that hold numbers: the integer part is the token; a cell that is null or not a number has none."""
    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("double") + F.col("l_discount").cast("double")).alias("domain_code"))
    p = L.parse_codes(li).filter((F.size("labels") > 0) | (F.size("unknown") > 0))
    return p.select("l_orderkey", "l_linenumber", *[F.array_join(c, ",").alias(c) for c in ("labels", "unknown")])


@query("convert_gold", "LAB-15",
       sql("SELECT coalesce(s.report_id, '') AS report_id, s.sentence_idx, md5(coalesce(s.sentence, '')) AS digest, "
           "coalesce(l.labels, 'other_general') AS labels FROM sheet s LEFT JOIN (SELECT doc_id, sentence_idx, "
           "string_agg(id, ',' ORDER BY i) AS labels FROM sheet_ids GROUP BY ALL) l USING (doc_id, sentence_idx) "
           "WHERE s.report_id IS NOT NULL OR s.sentence IS NOT NULL", "sheet", "sheet_ids"))
def _(spark, sf):
    g = L.convert_gold(sheet(spark, sf))
    return g.select("report_id", "sentence_idx", F.md5(F.encode("sentence", "UTF-8")).alias("digest"),
                    F.array_join("labels", ",").alias("labels"))


cte("silver", "SELECT report_id, sentence_idx, domain_id, max(coalesce(confidence, 0e0)) AS confidence, min(pos) AS pos "
    "FROM silver_items GROUP BY ALL", "silver_items")
cte("gold", "SELECT report_id, sentence_idx, domain_id, min(pos) AS pos FROM gold_items GROUP BY ALL", "gold_items")


def silver(spark, sf):
    return L.canonical(X.silver_items(spark, sf))


@query("canonical_labels", "LAB-18", sql("SELECT * FROM silver", "silver"))
def _(spark, sf):
    return silver(spark, sf)


@query("canonical_labels_with_fallback", "LAB-18",
       sql("SELECT s.report_id, s.sentence_idx, coalesce(g.domain_id, 'other_general') AS domain_id, coalesce(g.confidence, 0e0) AS confidence "
           "FROM (SELECT DISTINCT report_id, sentence_idx FROM silver_items) s LEFT JOIN (SELECT report_id, sentence_idx, domain_id, "
           "max(coalesce(confidence, 0e0)) AS confidence FROM silver_items WHERE confidence >= 5 GROUP BY ALL) g "
           "USING (report_id, sentence_idx)", "silver_items"))
def _(spark, sf):
    items = X.silver_items(spark, sf)
    keys = items.select(*L.KEYS).distinct()
    return L.canonical_with_fallback(items.filter("confidence >= 5"), keys).drop("pos")


@query("last_label_row_wins", "LAB-18",
       sql("SELECT report_id, sentence_idx, domain_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY report_id, sentence_idx "
           "ORDER BY pos DESC, domain_id DESC) AS rn FROM silver_items) WHERE rn = 1", "silver_items"))
def _(spark, sf):
    items = X.silver_items(spark, sf).select(*L.KEYS, "domain_id", "pos")
    return L.last_row_per_key(items, ["pos", "domain_id"])


# mixed label lists: plain ids, structs, repeats and blanks, as JSON text
MIXED = ("'{\"labels\": [\"' || {a} || '\", {\"domain_id\": \"' || {b} || '\"}, \"' || {a} || '\", {\"other\": 1}, 5, {\"domain_id\": \"' || {c} || '\"}]}'")


def _mixed(engine: str) -> str:
    out = MIXED
    for k, e in (("{a}", "l_suppkey"), ("{b}", "l_partkey"), ("{c}", "l_orderkey")):
        out = out.replace(k, X._domain(e, engine))
    return out


@query("mixed_label_items", "LAB-19 FN-4",
       "WITH m AS (SELECT l_orderkey, l_linenumber, l_suppkey % 19 AS a, l_partkey % 19 AS b, l_orderkey % 19 AS c FROM lineitem) "
       f"SELECT l_orderkey, l_linenumber, {X.IDS}[a::INT + 1] || CASE WHEN b <> a THEN ',' || {X.IDS}[b::INT + 1] ELSE '' END || "
       f"CASE WHEN c <> a AND c <> b THEN ',' || {X.IDS}[c::INT + 1] ELSE '' END AS labels FROM m")
def _(spark, sf):
    d = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_mixed("spark")).alias("j"))
    d = d.withColumn("v", F.try_variant_get(F.try_parse_json("j"), "$.labels", "array<variant>"))
    return d.select("l_orderkey", "l_linenumber", F.array_join(L.mixed_items(F.col("v")), ",").alias("labels"))


@query("json_properties", "FN-6 FN-5 FN-8",
       "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, "
       "max(TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE)) AS missing FROM events GROUP BY 1")
def _(spark, sf):
    e = X.table(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint, missing double"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k_sum"), F.max("p.missing").alias("missing"))
