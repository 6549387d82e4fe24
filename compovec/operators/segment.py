"""Documents to sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compovec.functions import text as T

METHODS = ("tokenizer_aligned",)


def segment_array(df: DataFrame, text: str = "text", method: str = "tokenizer_aligned",
                  min_length: int = T.MIN_LENGTH, shield: bool = True) -> DataFrame:
    """Add ``sentences``, the sentence array of each document.

    One narrow stage: clean, shield, split, merge short pieces, undo the shield.
    """
    if method not in METHODS:
        raise ValueError(f"unsupported segmentation method {method!r}; use one of {METHODS}")
    out = df.withColumn("_t", T.clean_text(T.strip(F.col(text))))
    if shield:
        out = out.withColumn("_t", T.shield_points(F.col("_t")))
        out = out.withColumn("_t", T.shield_quotes(F.col("_t")))
        out = out.withColumn("_t", T.shield_parentheses(F.col("_t")))
    out = out.withColumn("_p", T.split_pieces(F.col("_t")))
    out = out.withColumn("_s", T.sentence_starts(F.col("_p"), min_length))
    merged = T.merge_pieces(F.col("_p"), F.col("_s"))
    if shield:
        merged = F.transform(merged, T.unshield)
    return out.withColumn("sentences", merged).drop("_t", "_p", "_s")


def segment_sentences(df: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """One row per sentence: keys, ``sentence_idx`` (0-based), ``sentence``."""
    arr = segment_array(df, text, **options)
    return T.explode_rows(arr, keys, "sentences", ("sentence_idx", "sentence"))


def overlong(sentences: DataFrame, max_length: int = T.MAX_LENGTH) -> DataFrame:
    """Sentences longer than the bound, with their length; nothing is cut."""
    return sentences.withColumn("n_chars", F.length("sentence")).filter(F.col("n_chars") > max_length)


def first_sentences(sentences: DataFrame, n: int = 64) -> DataFrame:
    """The leading ``n`` sentences of every document, as the encoder reads them."""
    return sentences.filter(F.col("sentence_idx") < n)


def mark_valid(sentences: DataFrame, min_tokens: int = 2) -> DataFrame:
    """Add ``n_tokens`` and ``valid`` (more than ``min_tokens`` tokens)."""
    s = sentences.withColumn("n_tokens", T.token_count(F.col("sentence")))
    return s.withColumn("valid", F.col("n_tokens") > min_tokens)


def valid_counts(sentences: DataFrame, key: str = "report_id", min_tokens: int = 2) -> DataFrame:
    m = mark_valid(sentences, min_tokens)
    return m.groupBy(key).agg(F.count_if("valid").alias("n_valid"), F.count("*").alias("n_sentences"))


def explode_words(sentences: DataFrame, keys: list[str], text: str = "sentence") -> DataFrame:
    return T.explode_rows(sentences, keys, T.words(F.col(text)), ("pos", "word")).drop("pos")


def with_diagnosis(reports: DataFrame, metadata: DataFrame, key: str = "report_id") -> DataFrame:
    """Reports with a known diagnosis: inner match, unknown and NaN dropped.

    Metadata has one row per report, so it grows with the data; the join is left
    to the optimizer, which broadcasts it only while its statistics are small.
    """
    known = metadata.filter(F.col("final_diag").isNotNull() & ~F.isnan("final_diag"))
    known = known.select(F.col("code").alias(key), F.col("final_diag").cast("int").alias("label"))
    return reports.join(known, key)


def worksheet(reports: DataFrame, listed: DataFrame, key: str = "report_id", **options) -> tuple[DataFrame, DataFrame]:
    """Blank annotation rows for the listed reports, and the listed reports that do not exist."""
    chosen = reports.join(listed.select(key).distinct(), key, "left_semi")
    rows = segment_sentences(chosen, [key], **options).withColumn("domain_code", F.lit(""))
    missing = listed.select(key).distinct().join(reports.select(key), key, "left_anti")
    return rows, missing
