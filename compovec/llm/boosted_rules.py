"""Quality rules: gradient-boosted trees over document statistics, as flat node arrays scored in bulk.

More symbols, repeated lines, repeated words or upper case can only lower a score (monotone constraints).  A
document fails the base rules with fewer than 50 words or with more than half of its words in repeated
3-word windows; of the rest the trees keep those whose score reaches ``KEEP``.

Null and empty texts have no words and so fail the base rules; without labels of both classes the trees keep
everything.  Extra columns are ignored by ``judge`` and kept by ``keep_good``; repeated rows share a verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from compovec.llm.common import documents, labelled, materialise
from compovec.llm.doc_stats import COUNTS, FEATURES, document_stats, statistics
from compovec.llm.rule_ensemble import training_rows
from compovec.llm.trees import Forest, boost

KEEP = 0.5
FALLING = ("symbols", "dup_lines", "repeats", "upper", "exclamations", "most_common", "adjacent")
MONOTONE = np.array([-1 if f in FALLING else 0 for f in FEATURES])


def fit(x: np.ndarray, y: np.ndarray) -> Forest | None:
    if len(y) == 0 or y.min() == y.max():
        return None
    return boost(x, y, monotone=MONOTONE)


def judged(model: Forest | None):
    def judge_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
        score = model.score(x) if model else np.ones(len(x))
        n, again = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n_words", "n_repeat_words"))
        failed = (n < 50) | (100 * again > 50 * n)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in COUNTS], pa.array(failed), pa.array(~failed & (score >= KEEP)),
                                           pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])
    return judge_batch


VERDICT = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"


def judge(stats: DataFrame, model: Forest | None) -> DataFrame:
    one = judged(model)
    return stats.select("doc_id", *COUNTS, *FEATURES).mapInArrow(lambda batches: (one(b) for b in batches), VERDICT)


def train(spark: SparkSession, stats: DataFrame, sf_dir: str) -> Forest | None:
    """Learns from the same fold as the classifier, so held-out accuracy can be told."""
    return fit(*training_rows(stats, labelled(spark, sf_dir, "quality", 4, 2)))


def op4_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict on every document."""
    stats = materialise(document_stats(documents(spark, sf_dir)), "rule-stats")
    return judge(stats, train(spark, stats, sf_dir))


def keep_good(docs: DataFrame, model: Forest | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the rules keep."""
    one, schema = judged(model), docs.schema

    def run(batches):
        from compovec.llm.common import slices
        for b in slices(batches):
            x = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column("text")], names=["doc_id", "text"])
            yield b.filter(one(statistics(x)).column("kept"))

    return docs.mapInArrow(run, schema)


QUERIES = {"op4_boosted_rules": op4_boosted_rules}
