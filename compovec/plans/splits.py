"""Splits of labelled documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from compovec.functions import text as T
from compovec.operators import splits as P
from compovec.plans import fixtures as X
from compovec.plans.registry import query
from compovec.plans.sqlkit import cte, sql

ORDER_ID = X.REPORT_ID.format(id="o_orderkey", half="(o_orderkey {div} 2)")
cte("people", "SELECT report_id, regexp_replace(report_id, '(?:-[0-9]+)?-[AP][0-9]+$', '') AS person, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM (SELECT " +
    ORDER_ID.format(div="//") + " AS report_id, o_orderstatus FROM orders)")


def people(spark, sf):
    o = X.table(spark, sf, "orders").select(F.expr(ORDER_ID.format(div="div")).alias("report_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    return o.withColumn("person", T.person_id(F.col("report_id")))


cte("profiles", "SELECT person, count(*) AS n, sum(label) AS pos, CASE WHEN sum(label) / count(*) >= 0.5 THEN 1 ELSE 0 END AS majority FROM people GROUP BY 1", "people")
cte("person_folds", "SELECT person, CAST((row_number() OVER (PARTITION BY n, pos ORDER BY md5('0-' || n::VARCHAR || '-' || pos::VARCHAR || '-' || person)) - 1) % 5 + 1 AS INT) AS fold FROM profiles", "profiles")


@query("stratified_group_folds", "SPL-1", sql("SELECT report_id, person, label, fold FROM people JOIN person_folds USING (person)", "people", "person_folds"))
def _(spark, sf):
    return P.stratified_group_folds(people(spark, sf), "person", "label")


@query("split_manifest", "SPL-2",
       sql("SELECT f.fold, CASE WHEN f.fold = p.fold THEN 'valid' ELSE 'train' END AS role, report_id, person FROM people JOIN person_folds p USING (person), (VALUES (1), (2), (3), (4), (5)) f(fold)", "people", "person_folds"))
def _(spark, sf):
    return P.manifest(P.stratified_group_folds(people(spark, sf), "person", "label")).select("fold", "role", "report_id", "person")


@query("person_holdout", "SPL-3",
       sql("SELECT report_id, person, CASE WHEN i <= ceil(m * 0.2) THEN 'test' ELSE 'train' END AS part FROM people JOIN (SELECT person, row_number() OVER (PARTITION BY majority ORDER BY md5('0-' || majority::VARCHAR || '-' || person)) AS i, "
           "count(*) OVER (PARTITION BY majority) AS m FROM profiles) USING (person)", "people", "profiles"))
def _(spark, sf):
    return P.holdout(people(spark, sf), "person", "label", 0.2).select("report_id", "person", "part")


@query("stratified_row_folds", "SPL-4",
       sql("SELECT report_id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('0-' || label::VARCHAR || '-' || report_id)) - 1) % 5 + 1 AS INT) AS fold FROM people", "people"))
def _(spark, sf):
    return P.row_folds(people(spark, sf), ["report_id"], 5, ["label"]).select("report_id", "fold")


@query("plain_row_folds", "SPL-4", sql("SELECT report_id, CAST((row_number() OVER (ORDER BY md5('0-' || report_id)) - 1) % 5 + 1 AS INT) AS fold FROM people", "people"))
def _(spark, sf):
    return P.row_folds(people(spark, sf), ["report_id"], 5).select("report_id", "fold")


@query("out_of_fold_scores", "SPL-5",
       sql("SELECT report_id, fold, CAST(length(person) * fold + label AS BIGINT) AS score FROM people JOIN person_folds USING (person)", "people", "person_folds"))
def _(spark, sf):
    folds = P.stratified_group_folds(people(spark, sf), "person", "label")
    every = folds.drop("fold").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5))))
    scored = every.withColumn("score", (F.length("person") * F.col("fold") + F.col("label")).cast("bigint")).select("report_id", "fold", "score")
    return P.out_of_fold(scored, folds, "report_id")
