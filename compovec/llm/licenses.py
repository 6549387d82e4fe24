"""License scan with ordered signature rules, on column expressions only.

One pass over the texts and no shuffle: a cheap pattern gates the few texts that can match at all; those are
normalised to blank-separated words, the keywords present select the rules to try, every match becomes an
interval of words, and an interval inside one of equal or higher priority is suppressed.

Null text counts as empty (no words, null positions, empty labels, score 0).  Repeated rows keep their own
results; equal intervals of one level go to the alphabetically first label; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compovec.llm.common import documents
from compovec.llm.license_rules import GATE_STRINGS, GATE_WORDS, RULES, WEIGHTS

# What counts as a word, and the base phrases with their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]++"          # the rest, before lower-casing
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INTERVAL = "struct<start:int,stop:int,level:int,label:string>"


def normal_form(text: Column) -> Column:
    """Words of the text in lower case (A to Z), each preceded and followed by one blank."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), BETWEEN, " ")), F.lit(" "))


def may_match(lower: Column) -> Column:
    """A cheap test that passes every text with a match, on the text in lower case."""
    out = F.lit(False)
    for s in GATE_STRINGS:
        out = out | F.contains(lower, F.lit(s))
    return out | lower.rlike(rf"(?<![a-z0-9])(?:{'|'.join(GATE_WORDS)})(?![a-z0-9])")


def blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def places(norm: Column, pattern: Column, level: Column, label: Column) -> Column:
    """Word intervals of all matches of a pattern: between the matches lie the pieces that ``split`` leaves."""
    found = F.regexp_extract_all(norm, pattern, F.lit(0))
    pieces = F.split(norm, pattern)
    steps = F.arrays_zip(pieces.alias("piece"), found.alias("hit"))

    def step(acc, x):
        start = acc["at"] + blanks(x["piece"])
        stop = start + blanks(x["hit"])
        one = F.struct(start.alias("start"), stop.alias("stop"), level.alias("level"), label.alias("label"))
        return F.struct(stop.cast("int").alias("at"), F.array_append(acc["out"], one.cast(INTERVAL)).alias("out"))

    none = F.array().cast(f"array<{INTERVAL}>")
    folded = F.aggregate(F.slice(steps, F.lit(1), F.size(found)), F.struct(F.lit(0).cast("int").alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(F.size(found) > 0, folded).otherwise(none)


def detections(norm: Column) -> Column:
    """All rule matches as intervals, larger and more specific ones first."""
    # one literal, not thousands of expression nodes
    table = [{"keyword": r.keyword, "pattern": f" (?:{r.pattern})(?= )", "level": r.level, "label": r.label} for r in RULES]
    rules = F.from_json(F.lit(json.dumps(table)), "array<struct<keyword:string,pattern:string,level:int,label:string>>")
    tried = F.filter(rules, lambda r: F.contains(norm, r["keyword"]))
    found = F.flatten(F.transform(tried, lambda r: places(norm, r["pattern"], r["level"], r["label"])))

    def before(a, b):
        key = [(a["start"], b["start"]), (b["stop"], a["stop"]), (a["level"], b["level"]), (a["label"], b["label"])]
        out = F.lit(0)
        for x, y in reversed(key):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return F.array_sort(found, before)


def resolve(found: Column) -> Column:
    """Drop each interval that lies inside an earlier one of the same or a more specific level.

    Intervals come ordered by start, longest first, so only the furthest end seen so far per level matters.
    """
    levels = range(len(WEIGHTS))

    def step(acc, d):
        reach = F.coalesce(*[F.when(d["level"] == n, acc[f"reach{n}"]) for n in levels])
        return F.struct(*[F.when((d["level"] <= n) & (d["stop"] > acc[f"reach{n}"]), d["stop"]).otherwise(acc[f"reach{n}"]).alias(f"reach{n}") for n in levels],
                        F.when(d["stop"] > reach, F.array_append(acc["kept"], d)).otherwise(acc["kept"]).alias("kept"))

    start = F.struct(*[F.lit(-1).cast("int").alias(f"reach{n}") for n in levels], F.array().cast(f"array<{INTERVAL}>").alias("kept"))
    return F.aggregate(found, start, step, lambda a: a["kept"])


def confidence(kept: Column) -> Column:
    """Noisy-or of the weights of what was kept."""
    weight = lambda d: F.coalesce(*[F.when(d["level"] == n, F.lit(1.0 - w)) for n, w in enumerate(WEIGHTS)])
    return F.lit(1.0) - F.aggregate(kept, F.lit(1.0), lambda a, d: a * weight(d))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, base phrase places, and the resolved license intervals (in words) of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    norm = F.col("_norm")
    out = docs.withColumn("n_words", F.regexp_count(t, F.lit(ANY_CASE_WORD)).cast("long"))
    out = out.withColumn("_lower", F.lower(t)).withColumn("_norm", F.when(may_match(F.col("_lower")), normal_form(t))).drop("_lower")
    hits = {p: F.when(F.contains(norm, F.lit(f" {p} ")), F.regexp_count(norm, F.lit(f"(?<= ){p}(?= )"))).otherwise(0) for p in PHRASES}
    first = [F.when(F.contains(norm, F.lit(f" {p} ")), blanks(F.substring_index(norm, f" {p} ", 1))) for p in PHRASES]
    last = [F.when(F.contains(norm, F.lit(f" {p} ")), F.col("n_words") - blanks(F.substring_index(norm, f" {p} ", -1)) - len(p.split())) for p in PHRASES]
    out = out.withColumns({
        "n_base": F.coalesce(sum(hits.values(), F.lit(0)), F.lit(0)).cast("long"),
        "first_word": F.least(*first).cast("long"), "last_word": F.greatest(*last).cast("long"),
        "base_labels": F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()])),
        "licenses": F.when(norm.isNull(), F.array().cast(f"array<{INTERVAL}>")).otherwise(resolve(detections(norm)))})
    return out.drop("_norm")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query, from the scan's own results."""
    found = scan(docs.select("doc_id", "text"))
    labels = F.array_sort(F.array_union("base_labels", F.transform("licenses", lambda d: d["label"])))
    base = F.when(F.size("base_labels") > 0, 0.5).otherwise(1.0)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
                        F.array_join(labels, ",").alias("labels"), (F.lit(1.0) - base * (F.lit(1.0) - confidence(F.col("licenses")))).alias("score"),
                        F.size("licenses").alias("n_detections"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of every document."""
    return digest(documents(spark, sf_dir))


QUERIES = {"op8_license_scan": op8_license_scan}
