"""Binary classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def with_probability(df: DataFrame, logit: str = "logit", threshold: float = 0.5) -> DataFrame:
    """Add ``prob`` and ``predicted``."""
    d = df.withColumn("prob", sigmoid(F.col(logit)))
    return d.withColumn("predicted", (F.col("prob") >= threshold).cast("int"))


def confusion_counts(df: DataFrame, sets: list[list[str]], dims: list[str], label: str = "label",
                     predicted: str = "predicted") -> DataFrame:
    """TP, FP, TN, FN for every grouping set in one pass."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    aggs = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
            F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(*aggs)


def metrics(c: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, specificity and F1 with zero guards."""
    r = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    m = c.withColumn("accuracy", r(tp + tn, tp + fp + tn + fn)).withColumn("precision", r(tp, tp + fp))
    m = m.withColumn("recall", r(tp, tp + fn)).withColumn("specificity", r(tn, tn + fp))
    return m.withColumn("f1", r(2 * tp, 2 * tp + fp + fn))
