"""Customer compositions as the example cohort: quantity over nineteen domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compovec.operators import composition as C
from compovec.operators import coordinates as Z
from compovec.plans import fixtures as X
from compovec.plans.sqlkit import cte
from compovec.sources import ontology

ALL = ontology.ids()
D = len(ALL)
EPS = 1e-6
CUST_ID = "'PER-' || lpad(cast(c_custkey as string), 12, '0') || CASE WHEN c_mktsegment = 'BUILDING' THEN '-1-P01' ELSE '-1-A01' END"

cte("cust_mass", "SELECT o_custkey AS c_custkey, CAST((l_partkey + l_suppkey) % 19 AS INT) AS ord, sum(l_quantity) AS mass FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
cte("comp", f"SELECT {CUST_ID} AS report_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'P' ELSE 'A' END AS report_type, "
    "CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS label, d.ord, d.id AS domain_id, d.grp, coalesce(m.mass, 0e0) AS mass, "
    "coalesce(m.mass, 0e0) / sum(coalesce(m.mass, 0e0)) OVER (PARTITION BY c.c_custkey) AS prop FROM customer c SEMI JOIN cust_mass "
    "USING (c_custkey) CROSS JOIN domains d LEFT JOIN cust_mass m ON m.c_custkey = c.c_custkey AND m.ord = d.ord", "cust_mass", "domains")


def coords_ctes(suffix: str, source: str, eps: str = "1e-6", by: str = "") -> None:
    """clr, ilr and their residuals of a long composition table; ``by`` adds partition columns."""
    b = f"{by}, " if by else ""
    cte(f"clr{suffix}", f"SELECT *, ln(prop + {eps}) - avg(ln(prop + {eps})) OVER (PARTITION BY {b}report_id) AS clr FROM {source}", source)
    cte(f"clr_res{suffix}", f"SELECT *, clr - avg(clr) OVER (PARTITION BY {b}report_type, ord) AS clr_res FROM clr{suffix}", f"clr{suffix}")
    cte(f"ilr{suffix}", f"SELECT {b}report_id, report_type, label, ord AS i, ilr, ilr - avg(ilr) OVER (PARTITION BY {b}report_type, ord) AS ilr_res "
        f"FROM (SELECT *, sqrt((ord + 1e0) / (ord + 2e0)) * (avg(clr) OVER w - lead(clr) OVER w2) AS ilr FROM clr{suffix} "
        f"WINDOW w AS (PARTITION BY {b}report_id ORDER BY ord), w2 AS (PARTITION BY {b}report_id ORDER BY ord)) WHERE ilr IS NOT NULL", f"clr{suffix}")


cte("cohort", "SELECT * FROM comp WHERE label = 1", "comp")
coords_ctes("", "cohort")


def compositions(spark, sf) -> DataFrame:
    """(report_id, report_type, label, mass, prop) for every customer with orders."""
    li = X.table(spark, sf, "lineitem").select("l_orderkey", ((F.col("l_partkey") + F.col("l_suppkey")) % D).alias("ord"), "l_quantity")
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    cells = [F.coalesce(F.sum(F.when(F.col("ord") == i, F.col("l_quantity"))), F.lit(0.0)) for i in range(D)]
    mass = rows.groupBy("o_custkey").agg(F.array(*cells).alias("mass"))
    cust = X.table(spark, sf, "customer").select(
        "c_custkey", F.expr(CUST_ID).alias("report_id"), F.when(F.col("c_mktsegment") == "BUILDING", "P").otherwise("A").alias("report_type"),
        F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("label"), "c_acctbal")
    j = mass.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return C.proportions(j.select("report_id", "report_type", "label", "mass")).drop("present")


def cohort(spark, sf) -> DataFrame:
    """Labelled customers with CLR, ILR and type-adjusted coordinates."""
    c = compositions(spark, sf).filter("label = 1")
    c = Z.add_coordinates(c, D)
    return Z.residualise(c, {"clr": D, "ilr": D - 1})
