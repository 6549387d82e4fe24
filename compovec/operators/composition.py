"""Label mass per document: selected sentences, allocation, dense vectors, match statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compovec.functions import arrays as A
from compovec.sources import ontology

KEYS = ["report_id", "sentence_idx"]
ALLOCATIONS = ("equal", "confidence", "hits")


def nest(labels: DataFrame) -> DataFrame:
    """Long canonical labels to one array per sentence, at most one entry per domain."""
    item = F.struct("pos", "domain_id", "confidence")
    g = labels.groupBy(*KEYS).agg(F.sort_array(F.collect_list(item)).alias("_l"))
    return g.select(*KEYS, F.transform("_l", lambda x: F.struct(
        x["domain_id"].alias("domain_id"), x["confidence"].alias("confidence"))).alias("labels"))


def from_ids(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Arrays of ids to arrays of (domain_id, confidence) with confidence 1."""
    return df.withColumn(labels, F.transform(labels, lambda d: F.struct(
        d.alias("domain_id"), F.lit(1.0).alias("confidence"))))


def match(selected: DataFrame, labels: DataFrame, active: list[str]) -> DataFrame:
    """Selected sentences left-joined to their labels and classified.

    ``status`` is ``no_label``, ``no_active_domain`` or ``matched``; ``mapped``
    holds the labels whose domain is active.
    """
    j = selected.join(labels.select(*KEYS, "labels"), KEYS, "left")
    mapped = F.filter("labels", lambda x: x["domain_id"].isin(*active))
    j = j.withColumn("mapped", F.coalesce(mapped, F.filter("labels", lambda x: F.lit(False))))
    status = (F.when(F.col("labels").isNull(), "no_label")
              .when(F.size("mapped") <= 0, "no_active_domain").otherwise("matched"))
    return j.withColumn("status", status)


def weights(mapped: Column, allocation: str = "equal") -> Column:
    """Mass of each mapped label: an equal split, a split by confidence, or one per hit."""
    if allocation not in ALLOCATIONS:
        raise ValueError(f"unknown allocation {allocation!r}; use one of {ALLOCATIONS}")
    if allocation == "hits":
        return F.transform(mapped, lambda x: F.struct(x["domain_id"].alias("domain_id"), F.lit(1.0).alias("w")))
    def split(labels: Column) -> Column:
        equal = F.lit(1.0) / F.size(labels)
        if allocation == "equal":
            return F.transform(labels, lambda x: F.struct(x["domain_id"].alias("domain_id"), equal.alias("w")))
        total = A.total(F.transform(labels, lambda x: x["confidence"]))
        return A.let(total, lambda t: F.transform(labels, lambda x: F.struct(
            x["domain_id"].alias("domain_id"), F.when(t > 0, x["confidence"] / t).otherwise(equal).alias("w"))))

    return A.let(mapped, split)


def mass(matched: DataFrame, allocation: str = "equal", by: list[str] = ["report_id"]) -> DataFrame:
    """Long label mass: one row per matched sentence and mapped label."""
    # unmatched sentences have nothing mapped; dropping them after the explode
    # keeps the label expressions out of a pushed-down filter
    rows = matched.select(*by, F.inline_outer(weights(F.col("mapped"), allocation)))
    return rows.filter(F.col("domain_id").isNotNull())


def dense(mass_rows: DataFrame, active: list[str], by: list[str] = ["report_id"],
          reports: DataFrame | None = None) -> DataFrame:
    """One vector of masses per report, zeros filled.

    Conditional sums over the fixed domain list: a single exchange of partial
    sums, no pivot job and no report-by-domain product.  ``reports`` adds
    all-zero rows for reports without any mass.
    """
    cols = [F.coalesce(F.sum(F.when(F.col("domain_id") == d, F.col("w"))), F.lit(0.0)) for d in active]
    v = mass_rows.groupBy(*by).agg(F.array(*cols).alias("mass"))
    if reports is not None:
        zero = F.array(*[F.lit(0.0)] * len(active))
        v = reports.select(*by).distinct().join(v, by, "left").withColumn("mass", F.coalesce("mass", zero))
    return v


def proportions(vectors: DataFrame, drop: int | None = None, renormalise: bool = True) -> DataFrame:
    """Add ``prop`` and ``present``; ``drop`` removes one domain before or after closing the row."""
    def without(a: Column) -> Column:
        return F.concat(F.slice(a, 1, drop), F.slice(a, F.lit(drop + 2), F.size(a)))
    v = vectors
    if drop is not None and not renormalise:
        v = v.withColumn("prop", without(A.closure(F.col("mass")))).withColumn("mass", without(F.col("mass")))
    else:
        if drop is not None:
            v = v.withColumn("mass", without(F.col("mass")))
        v = v.withColumn("prop", A.closure(F.col("mass")))
    return v.withColumn("present", F.transform("mass", lambda x: (x > 0).cast("int")))


def long(vectors: DataFrame, columns: list[str], names: list[str], keys: list[str] = ["report_id"]) -> DataFrame:
    """Vector columns to rows (keys, ord, domain_id, columns...)."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    rows = vectors.select(*keys, F.posexplode_outer(zipped).alias("ord", "_z")).filter("ord is not null")
    ids = F.array(*[F.lit(n) for n in names])
    return rows.select(*keys, "ord", F.get(ids, F.col("ord")).alias("domain_id"), *[F.col("_z")[c].alias(c) for c in columns])


def wide(vectors: DataFrame, column: str, names: list[str], keys: list[str] = ["report_id"], digits: int | None = 4) -> DataFrame:
    """One column per domain, for sinks."""
    cells = [F.get(F.col(column), F.lit(i)) for i in range(len(names))]
    if digits is not None:
        cells = [F.round(c, digits) for c in cells]
    return vectors.select(*keys, *[c.alias(n) for c, n in zip(cells, names)])


def statistics(matched: DataFrame) -> DataFrame:
    """One row of match counts over all selected sentences."""
    n_labels = F.when(F.col("labels").isNotNull(), F.size("labels")).otherwise(0)
    n_mapped = F.when(F.col("status") == "matched", F.size("mapped")).otherwise(0)
    s = matched.select("status", n_labels.alias("nl"), n_mapped.alias("nm")).agg(
        F.count("*").alias("total_selected"),
        F.count_if(F.col("status") == "matched").alias("matched"),
        F.count_if(F.col("status") == "no_label").alias("no_label"),
        F.count_if(F.col("status") == "no_active_domain").alias("no_active_domain"),
        F.sum("nm").alias("assignments"), (F.sum("nl") - F.sum("nm")).alias("discarded"))
    return s.withColumn("match_rate", F.col("matched") / F.greatest(F.lit(1), F.col("total_selected")))


def details(matched: DataFrame) -> DataFrame:
    """Per report: selected, matched, and the domains found in rank order.

    The list is bounded by k times the label cap.
    """
    hits = F.when(F.col("status") == "matched", F.struct("rank", F.transform("mapped", lambda x: x["domain_id"]).alias("d")))
    g = matched.withColumn("_h", hits).groupBy("report_id").agg(
        F.count("*").alias("n_selected"), F.count_if(F.col("status") == "matched").alias("n_matched"),
        F.sort_array(F.collect_list("_h")).alias("_l"))
    return g.select("report_id", "n_selected", "n_matched",
                    F.flatten(F.transform("_l", lambda x: x["d"])).alias("domains_found"))


def hit_vector(details_rows: DataFrame, active: list[str]) -> DataFrame:
    """Closed vector of label hits, one per hit, from the domain list of each report; narrow."""
    def hits(d: str) -> Column:
        return F.size(F.filter("domains_found", lambda x: x == d)).cast("double")
    counts = F.array(*[hits(d) for d in active])
    return details_rows.withColumn("mass", counts).withColumn("prop", A.closure(F.col("mass")))


def prototype(long_rows: DataFrame, value: str = "prop", by: list[str] | None = None) -> DataFrame:
    """Mean composition, overall or per group."""
    return long_rows.groupBy(*(by or []), "domain_id").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def other_position(active: list[str]) -> int:
    return active.index(ontology.FALLBACK)
