"""Noisy votes to one consolidated label set per sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compovec.functions import responses as J
from compovec.functions.text import explode_rows
from compovec.sources import ontology

KEYS = ["report_id", "sentence_idx"]


def parse_votes(votes: DataFrame, valid: list[str] | None = None) -> DataFrame:
    """Responses to normalised items; narrow.

    Adds ``items`` (first label per domain of the vote) and keeps ``error``.  A
    response that parses to something other than an object fails its vote.
    """
    valid = ontology.ids() if valid is None else valid
    v = votes.withColumn("_raw", J.extract_json(F.col("response_text")))
    v = v.withColumn("_v", J.parse_response(F.col("_raw")))
    bad = F.col("_v").isNotNull() & ~F.ltrim("_raw").startswith("{")
    v = v.withColumn("error", F.coalesce("error", F.when(bad, F.lit("response is not an object"))))
    v = v.withColumn("_items", J.normalise_items(J.label_items(F.col("_v")), valid, J.id_to_code()))
    empty = F.array().cast(f"array<{J.ITEM}>")
    items = F.when(F.col("error").isNull(), F.coalesce("_items", empty)).otherwise(empty)
    v = v.withColumn("_items", items)
    return v.withColumn("items", J.first_per_domain(F.col("_items"))).drop("_raw", "_v", "_items")


def explode_items(parsed: DataFrame) -> DataFrame:
    """One row per label item with its vote and position."""
    rows = explode_rows(parsed, KEYS + ["vote_no"], "items", ("item_pos", "item"))
    return rows.select(*KEYS, "vote_no", "item_pos", "item.*")


def consolidate(parsed: DataFrame, n_votes: int = 5, ratio: float = 0.5, min_confidence: float = 0.5,
                max_labels: int = 3, valid: list[str] | None = None) -> DataFrame:
    """Majority labels of each sentence.

    First aggregation: (sentence, domain), combined map-side.  Second: sentence,
    over at most one row per domain, so no group can grow with the data.  A
    failed vote fails its sentence; no surviving domain means the fallback.
    """
    fallback = ontology.fallback_id(valid)
    # an errored or empty vote leaves one row with a null domain
    rows = parsed.select(*KEYS, "vote_no", "error", F.posexplode_outer("items").alias("item_pos", "item"))
    rows = rows.select(*KEYS, "vote_no", "error", "item_pos", "item.*")
    per_domain = rows.groupBy(*KEYS, "domain_id").agg(
        F.count("domain_id").alias("votes"),
        F.sum("confidence").alias("conf_sum"),
        F.min(F.struct("vote_no", "item_pos")).alias("seen"),
        F.max_by("rationale", F.struct(F.length("rationale"), -F.col("vote_no"))).alias("rationale"),
        F.max("domain_code").alias("domain_code"),
        F.min(F.when(F.col("error").isNotNull(), F.struct("vote_no", "error"))).alias("failure"),
    )
    mean = F.round(F.col("conf_sum") / F.col("votes"), 12)
    wins = F.col("domain_id").isNotNull() & (F.col("votes") / n_votes >= ratio) & (mean >= min_confidence)
    winner = F.when(wins, F.struct(
        (-F.round(mean, 3)).alias("k1"), F.col("seen").alias("k2"), "domain_id", "domain_code",
        F.round(mean, 3).alias("confidence"), "rationale"))
    per_sentence = per_domain.withColumn("winner", winner).groupBy(*KEYS).agg(
        F.sort_array(F.collect_list("winner")).alias("winners"),
        F.min("failure").alias("failure"),
        F.round(F.round(F.sum("conf_sum") / F.sum("votes"), 12), 3).alias("mean_all"),
    )
    code = J.id_to_code().get(fallback)
    chosen = F.slice("winners", 1, max_labels) if max_labels else F.col("winners")
    chosen = F.transform(chosen, lambda w: F.struct(
        w["domain_id"].alias("domain_id"), w["domain_code"].alias("domain_code"),
        w["confidence"].alias("confidence"), w["rationale"].alias("rationale")))
    catch_all = F.array(F.struct(
        F.lit(fallback).alias("domain_id"), F.lit(code).alias("domain_code"),
        F.coalesce("mean_all", F.lit(0.0)).alias("confidence"),
        F.lit("Below threshold; using fallback").alias("rationale")))
    labels = (F.when(F.col("failure").isNotNull(), F.array().cast(f"array<{J.ITEM}>"))
              .when(F.size("winners") == 0, catch_all).otherwise(chosen))
    return per_sentence.select(*KEYS, labels.cast(f"array<{J.ITEM}>").alias("labels"),
                               F.col("failure.error").alias("error"))


def failures(votes: DataFrame) -> DataFrame:
    """Sentences with a failed vote and their first error."""
    bad = votes.filter(F.col("error").isNotNull())
    return bad.groupBy(*KEYS).agg(F.min_by("error", "vote_no").alias("error"), F.count("*").alias("n_failed"))


def label_rows(labeled: DataFrame) -> DataFrame:
    """Long form of consolidated labels."""
    rows = explode_rows(labeled, KEYS, "labels", ("pos", "item"))
    return rows.select(*KEYS, "pos", "item.*")


def remaining(sentences: DataFrame, done: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Sentences that have no output row yet; failed ones count as done unless retried."""
    if retry_errors:
        done = done.filter(F.col("error").isNull())
    return sentences.join(done.select(*KEYS).distinct(), KEYS, "left_anti")


def restrict(reports: DataFrame, names: list[str] | None = None, first_n: int | None = None) -> DataFrame:
    """Named reports, or the first ``n`` in id order."""
    if names is not None:
        reports = reports.filter(F.col("report_id").isin(list(names)))
    if first_n is not None:
        reports = reports.orderBy("report_id").limit(first_n)
    return reports
