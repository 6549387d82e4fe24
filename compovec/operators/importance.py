"""Sentence importance from weight tables, and top-k selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = {"column_sum": "k", "row_sum": "q"}


def restrict_to_valid(edges: DataFrame, valid: DataFrame) -> DataFrame:
    """Edges between valid sentences; ``valid`` holds (report_id, sentence_idx)."""
    for end in ("q", "k"):
        v = valid.select("report_id", F.col("sentence_idx").alias(end)).distinct()
        edges = edges.join(v, ["report_id", end], "left_semi")
    return edges


def importance(edges: DataFrame, method: str = "column_sum", valid: DataFrame | None = None) -> DataFrame:
    """Weight received (``column_sum``) or given (``row_sum``) by every sentence.

    Keyed by (report, sentence), so one huge report still spreads over tasks.
    With ``valid``, masked sentences are left out.
    """
    if method not in METHODS:
        raise ValueError(f"unknown importance method {method!r}; use one of {sorted(METHODS)}")
    imp = edges.groupBy("report_id", F.col(METHODS[method]).alias("sentence_idx")).agg(F.sum("w").alias("importance"))
    if valid is not None:
        imp = imp.join(valid.select("report_id", "sentence_idx").distinct(), ["report_id", "sentence_idx"], "left_semi")
    return imp


def top_k(imp: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """The ``k`` most important sentences per report, ties by position.

    A row-number filter lets Spark keep only ``k`` rows per report in every map
    task before the exchange, so a hot report costs ``k`` rows per task.
    """
    w = Window.partitionBy("report_id").orderBy(F.desc("importance"), "sentence_idx")
    top = imp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select("report_id", "rank", "sentence_idx", F.round("importance", digits).alias("attention_score"))


def most_attended(imp: DataFrame) -> DataFrame:
    """The single most important sentence of every report."""
    key = F.struct("importance", -F.col("sentence_idx"))
    return imp.groupBy("report_id").agg(F.max_by("sentence_idx", key).alias("sentence_idx"),
                                        F.max("importance").alias("importance"))


def normalise_rows(edges: DataFrame) -> DataFrame:
    """Weights of a query sentence scaled to sum to one; repeated pairs are summed first."""
    pairs = edges.groupBy("report_id", "q", "k").agg(F.sum("w").alias("w"))
    total = F.sum("w").over(Window.partitionBy("report_id", "q"))
    return pairs.withColumn("w", F.col("w") / total)


def strong_pairs(pairs: DataFrame, threshold: float = 0.05) -> DataFrame:
    return pairs.filter(F.col("w") > threshold)


def peak_pair(pairs: DataFrame) -> DataFrame:
    """Largest weight of each report and where it is (first position on ties)."""
    at = F.max_by(F.struct("q", "k"), F.struct("w", -F.col("q"), -F.col("k")))
    peak = pairs.groupBy("report_id").agg(F.max("w").alias("max_weight"), at.alias("at"))
    return peak.select("report_id", "max_weight", "at.q", "at.k")


def sentence_profile(pairs: DataFrame) -> DataFrame:
    """Total and largest received weight of every sentence."""
    return pairs.groupBy("report_id", F.col("k").alias("sentence_idx")).agg(
        F.sum("w").alias("total_weight"), F.max("w").alias("max_weight"))


def extremes(df: DataFrame, value: str, ident: str, by: list[str] | None = None) -> DataFrame:
    """Ids of the highest and lowest value, overall or per group; first id on ties."""
    high = F.min_by(ident, F.struct(-F.col(value), F.col(ident)))
    low = F.min_by(ident, F.struct(F.col(value), F.col(ident)))
    return df.groupBy(*(by or [])).agg(
        high.alias("highest"), F.max(value).alias("high_value"), low.alias("lowest"), F.min(value).alias("low_value"))


def nested(top: DataFrame, extra: Column | None = None) -> DataFrame:
    """Top-k rows as one array per report; bounded by ``k``."""
    item = F.struct("rank", "sentence_idx", "attention_score", *([extra] if extra is not None else []))
    return top.groupBy("report_id").agg(F.sort_array(F.collect_list(item)).alias("sentences"))


def cut(nested_rows: DataFrame, k: int | None) -> DataFrame:
    """Nested top-k rows back to long form, re-ranked by ``rank`` and cut to ``k``."""
    long = nested_rows.select(*[c for c in nested_rows.columns if c != "sentences"],
                              F.inline_outer(F.sort_array("sentences")))
    long = long.filter(F.col("sentence_idx").isNotNull())
    return long if k is None else long.filter(F.col("rank") <= k)
