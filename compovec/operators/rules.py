"""Weighted keyword rules as one narrow projection.

A rule file is configuration of bounded size, so each domain's score is a sum
of match terms in a single projection: no join, no shuffle.  Patterns of plain
syntax are matched a batch of sentences at a time by Arrow, which scans without
backtracking; a domain with any other pattern keeps ``rlike``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compovec.functions import text
from compovec.sources import ontology


@dataclass(frozen=True)
class RuleSet:
    keywords: dict[str, list[tuple[str, float]]]
    negative: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    priority: list[str] = field(default_factory=list)


#: Syntax that both regular-expression engines read alike: plain characters, classes of them, groups, alternatives, single quantifiers, ``^``.
ALIKE = re.compile(r"(?:(?:[A-Za-z0-9 ,;_]|\[(?:[a-z]-[a-z]|[A-Z]-[A-Z]|[0-9]-[0-9]|[A-Za-z0-9 ,.;_])+\]|\))[?*+]?|\((?!\?)|\||\^(?![?*+]))+")


def alike(pattern: str) -> bool:
    """Whether Arrow finds ``pattern`` in the same sentences as ``rlike``."""
    return pattern.isalnum() or ALIKE.fullmatch(pattern) is not None


def matches(sentence: Column, pattern: str) -> Column:
    """Regular-expression search; a plain word is searched as bytes, which is far cheaper."""
    return sentence.contains(pattern) if pattern.isalnum() else sentence.rlike(pattern)


def score(sentence: Column, rules: RuleSet, domain: str) -> Column:
    """Each matching pattern adds its weight once; negatives add theirs."""
    terms = [
        F.when(matches(sentence, p), F.lit(float(w))).otherwise(F.lit(0.0))
        for p, w in rules.keywords.get(domain, []) + rules.negative.get(domain, [])
    ]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total


def batch_scores(sentence: Column, weighted: list[list[tuple[str, float]]]) -> Column:
    """Array of scores, one per list of weighted patterns, all of them ``alike``; weights add up in the order given."""

    def run(sentences: pa.Array) -> pa.Array:
        out = np.zeros((len(sentences), len(weighted)))
        for i, terms in enumerate(weighted):
            for p, w in terms:
                hit = pc.match_substring(sentences, p) if p.isalnum() else pc.match_substring_regex(sentences, p)
                out[:, i] += np.where(hit.fill_null(False).to_numpy(zero_copy_only=False), w, 0.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sentences) + 1) * len(weighted), pa.int32()), pa.array(out.ravel()))

    return F.arrow_udf(run, "array<double>")(sentence)


def scores(df: DataFrame, rules: RuleSet, sentence: str = "sentence") -> DataFrame:
    """Add ``scores``: one (domain_id, score, rank) struct per domain, rank by priority list."""
    rank = {d: i for i, d in enumerate(rules.priority)}
    weighted = {d: [(p, float(w)) for p, w in rules.keywords[d] + rules.negative.get(d, [])] for d in rules.keywords}
    plain = [d for d, terms in weighted.items() if terms and all(alike(p) for p, _ in terms)]
    if plain:
        df = df.withColumn("_plain", batch_scores(F.col(sentence), [weighted[d] for d in plain]))
    value = {d: F.get("_plain", F.lit(i)) for i, d in enumerate(plain)}
    items = [
        F.struct(
            F.lit(d).alias("domain_id"),
            (value[d] if d in value else score(F.col(sentence), rules, d)).alias("score"),
            F.lit(rank.get(d, 999)).alias("rank"),
            F.lit(i).alias("nth"),
        )
        for i, d in enumerate(rules.keywords)
    ]
    return df.withColumn("scores", F.array(*items)).drop("_plain")


def classify(df: DataFrame, rules: RuleSet, max_labels: int = 3, min_score: float = 1.0,
             sentence: str = "sentence", fallback: str = ontology.FALLBACK) -> DataFrame:
    """Add ``labels``: up to ``max_labels`` domain ids by score, else the fallback.

    Sorting by (-score, priority, position) inside the row keeps it narrow.
    """
    scored = scores(df, rules, sentence).withColumn("_kept", F.filter("scores", lambda s: s["score"] >= min_score))
    keyed = F.transform("_kept", lambda s: F.struct(
        (-s["score"]).alias("k1"), s["rank"].alias("k2"), s["nth"].alias("k3"), s["domain_id"].alias("domain_id")))
    chosen = F.transform(F.slice(F.sort_array(keyed), 1, max_labels), lambda s: s["domain_id"])
    blank = F.coalesce(text.strip(F.col(sentence)), F.lit("")) == ""
    labels = F.when(blank | (F.size("_kept") == 0), F.array(F.lit(fallback))).otherwise(chosen)
    return scored.withColumn("labels", labels).drop("scores", "_kept")


def explode_scores(df: DataFrame, rules: RuleSet, keys: list[str], sentence: str = "sentence") -> DataFrame:
    """Long form of the non-zero scores."""
    s = scores(df, rules, sentence).select(*keys, F.inline_outer("scores"))
    return s.filter("score != 0").select(*keys, "domain_id", "score")
