"""Training-data pipeline: five stages over ``documents``, each one of the operators of ``compovec.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
scratch folder and hands the reread table to the next stage.  All stages but the last return the columns of
``documents``, extra ones included.  Stages that learn take their labels from ``labels`` outside the held-out folds
and their texts from their own input.  An empty table passes through every stage; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compovec.llm import boosted_rules, guess_cost, jaccard_groups, mil_toxicity, slack_packing
from compovec.llm.common import bound_batches, documents, labelled, materialise, sample_by_hash
from compovec.llm.doc_stats import document_stats
from compovec.llm.rule_ensemble import SAMPLE, training_rows


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches the rejection bar."""
    bound_batches(spark)
    return mil_toxicity.keep_clean(docs, mil_toxicity.train(spark, docs, labelled(spark, sf_dir, "toxic", 3, 1)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or that the boosted rules reject."""
    bound_batches(spark)
    labels = sample_by_hash(labelled(spark, sf_dir, "quality", 4, 2), "doc_id", SAMPLE)
    some = docs.select("doc_id", "text").join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")      # at most about SAMPLE ids
    model = boosted_rules.fit(*training_rows(document_stats(some), labels))
    return boosted_rules.keep_good(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every near-duplicate group.

    Repeated rows of one id leave one; rows without an id cannot be named and leave one of each text.
    """
    bound_batches(spark)
    groups = materialise(jaccard_groups.join(docs, count_links=False), "groups")
    gone = groups.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    again = groups.where(F.col("component_id") == F.col("doc_id")).groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone, again = materialise(gone, "gone"), materialise(again, "again")
    few = gone.count() + again.count() <= jaccard_groups.BROADCAST_IDS
    hint = F.broadcast if few else (lambda d: d)        # beyond the bound the ids are joined by a shuffle
    left = docs.join(hint(gone), "doc_id", "left_anti").select(docs.columns)
    single = left.where(F.col("doc_id").isNotNull()).join(hint(again), "doc_id", "left_anti").select(docs.columns)
    repeated = left.join(hint(again), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return single.unionByName(repeated).unionByName(left.where(F.col("doc_id").isNull()).dropDuplicates(["text"]))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret value in the text by a mark."""
    bound_batches(spark)
    return guess_cost.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return slack_packing.pack(docs)


STAGES = [("toxicity", without_toxic), ("quality_rules", good_quality), ("near_duplicates", one_of_each_group), ("secrets", without_secrets),
          ("packing", packed)]

#: Learnt models and tokenizers have no SQL form; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
