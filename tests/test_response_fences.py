"""Fenced responses are found by their marks."""

import re

from pyspark.sql import functions as F

from compovec.functions import responses as J


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


FENCED = ["``` a", "```json{}```", "````x```", "``````", "`````", "a```jsonjson {} ```b```", "```\n json\n```", "``` } {", "}{", "a}b", "{", "\u00e9{x}\u00e9}\u00e9", "", None,
          "```json```", "```j```json```", "{}```", "````json {1}````", "```\x0bjson {} ```", "no {\"a\": {}} more"]


def test_extract_json_reads_fences_without_the_pattern(spark):
    def want(c):
        if c is None:
            return None
        m = re.search(J.FENCE, c)
        if m:
            return m.group(1).strip()
        a, b = c.find("{"), c.rfind("}")
        return c[a:b + 1] if 0 <= a <= b else c.strip()

    df = spark.createDataFrame([(c,) for c in FENCED], "c string").repartition(2).withColumn("raw", J.extract_json(F.col("c")))
    assert "RLIKE" not in plan(df) and "reverse(" not in plan(df)
    for r in df.collect():
        assert r["raw"] == want(r["c"]), r["c"]
