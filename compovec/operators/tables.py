"""Summary tables over labels, cohorts and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["report_id", "sentence_idx"]


def label_summary(labeled: DataFrame) -> DataFrame:
    """Totals of a label file in one pass; ``labels`` is an array, ``error`` may be null.

    Reports are counted through a first aggregation per report, so the distinct
    count never sees a report twice and no report can be hot.
    """
    failed = F.col("error").isNotNull()
    n = F.when(failed, 0).otherwise(F.size(F.filter(F.coalesce("labels", F.array()), lambda x: F.coalesce(x["domain_id"], F.lit("")) != "")))
    per_report = labeled.select("report_id", failed.alias("f"), n.alias("n")).groupBy("report_id").agg(
        F.count("*").alias("total"), F.count_if("f").alias("errors"), F.count_if(~F.col("f") & (F.col("n") == 0)).alias("unlabeled"),
        F.count_if(F.col("n") >= 2).alias("multi"), F.sum("n").alias("labels"))
    t = per_report.agg(*[F.sum(c).alias(c) for c in ("total", "errors", "unlabeled", "multi", "labels")], F.count("*").alias("reports"))
    labelled = F.col("total") - F.col("errors") - F.col("unlabeled")
    return t.withColumn("labels_per_sentence", F.col("labels") / F.greatest(F.lit(1), labelled))


def domain_distribution(label_rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Label counts per domain with zero rows for unused domains."""
    c = label_rows.groupBy("domain_id").agg(F.count("*").alias("n"))
    return domains.select("ord", "code", F.col("id").alias("domain_id")).join(c, "domain_id", "left").fillna(0, ["n"])


def cardinality(label_rows: DataFrame) -> DataFrame:
    """How many sentences carry 1, 2, 3 ... labels."""
    n = label_rows.groupBy(*KEYS).agg(F.count("*").alias("n_labels"))
    return n.groupBy("n_labels").agg(F.count("*").alias("sentences"))


def cohort_table(reports: DataFrame, row: str, col: str, person: str) -> DataFrame:
    """Cross table with margins: reports and distinct people in every cell of the cube.

    People are reduced to one row per (row, col, person) first; the cube then
    works on that smaller table.
    """
    people = reports.groupBy(row, col, person).agg(F.count("*").alias("c"))
    return people.cube(row, col).agg(F.sum("c").alias("reports"), F.count_distinct(person).alias("people"))


def word_enrichment(words: DataFrame, class_sizes: DataFrame, label: str = "label", min_freq: float = 0.01, eps: float = 1e-6) -> DataFrame:
    """Word frequency per report in two classes, both ratios and the difference.

    Counting combines map-side, so frequent words arrive as one row per task.
    """
    n = words.groupBy("word", label).agg(F.count("*").alias("n"))
    f = n.join(F.broadcast(class_sizes), label).withColumn("freq", F.col("n") / F.col("reports"))
    pos = f.filter(F.col(label) == 1).select("word", F.col("freq").alias("pos_freq"))
    neg = f.filter(F.col(label) == 0).select("word", F.col("freq").alias("neg_freq"))
    j = outer_zero(pos, neg, ["word"], ["pos_freq", "neg_freq"])
    j = j.withColumn("pos_ratio", F.col("pos_freq") / (F.col("neg_freq") + eps)).withColumn("neg_ratio", F.col("neg_freq") / (F.col("pos_freq") + eps))
    j = j.withColumn("diff", F.col("pos_freq") - F.col("neg_freq"))
    return j.filter((F.col("pos_freq") >= min_freq) | (F.col("neg_freq") >= min_freq))


def outer_zero(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join of two frequency tables, missing counted as zero."""
    return a.join(b, keys, "full").fillna(0.0, values)


def pool_vectors(rows: DataFrame, vec: str, dim: int, valid: str | None = None, key: str = "report_id", pos: str = "sentence_idx") -> DataFrame:
    """Mean of a report's valid sentence vectors; the first sentence where none is valid."""
    ok = F.col(valid) if valid else F.lit(True)
    means = [F.avg(F.when(ok, F.get(F.col(vec), F.lit(i)).cast("double"))) for i in range(dim)]
    g = rows.groupBy(key).agg(F.count_if(ok).alias("_n"), F.array(*means).alias("_m"), F.min_by(F.col(vec), pos).alias("_first"))
    first = F.transform("_first", lambda x: x.cast("double"))
    return g.select(key, F.when(F.col("_n") > 0, F.col("_m")).otherwise(first).alias(vec))


def histogram(df: DataFrame, value: str, lo: float | None, hi: float | None, bins: int) -> DataFrame:
    """Density over equal bins of [lo, hi], the last bin closed; zero bins left out.

    Values below ``lo`` are counted in bin -1, values above ``hi`` in bin ``bins``, both without a density, so counts sum to the
    values; the densities of the others integrate to 1.  A bound of None is the least or largest value.  Null and NaN have no bin.
    """
    x = F.col(value).cast("double")
    d = df.filter(x.isNotNull() & ~F.isnan(x)).select(x.alias("_x"))
    ends = d.agg(*[(f("_x") if end is None else F.lit(float(end))).alias(n) for n, f, end in (("_lo", F.min, lo), ("_hi", F.max, hi))])
    flat = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(0.0)         # one value only: a range of width 1 around it
    ends = ends.select((F.col("_lo") - flat).alias("_lo"), (F.col("_hi") + flat).alias("_hi")).withColumn("_width", (F.col("_hi") - F.col("_lo")) / bins)
    d = d.crossJoin(F.broadcast(ends))                          # one row
    inner = F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_lo")) / F.col("_width")))
    b = F.when(F.col("_x") < F.col("_lo"), -1).when(F.col("_x") > F.col("_hi"), bins).otherwise(inner).cast("int")
    d = d.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.first("_width").alias("_width"))
    inside = F.when(F.col("bin").between(0, bins - 1), F.col("n"))
    total = F.sum(inside).over(Window.partitionBy(F.lit(1)))    # at most ``bins`` + 2 rows
    return d.select("bin", "n", (inside / (total * F.col("_width"))).alias("density"))


def separation(matrix: DataFrame, roles: DataFrame, bar: float, base: str = "convergent") -> DataFrame:
    """Per role of listed pairs: mean absolute correlation, robust pairs by sign, and how far the ``base`` role lies above it.

    ``matrix``: (domain_id, score, raw, clr); ``roles``: (role, domain_id, score), a short list.  A pair is robust if both
    correlations reach ``bar`` with one sign; pairs without a raw correlation do not count.
    """
    both = (F.signum("raw") == F.signum("clr")) & (F.abs("raw") >= bar) & (F.abs("clr") >= bar)
    m = matrix.filter("raw is not null").join(F.broadcast(roles), ["domain_id", "score"]).groupBy("role").agg(
        F.count("*").alias("pairs"), F.avg(F.abs("raw")).alias("mean_abs"), F.count_if(both & (F.col("raw") > 0)).alias("same_positive"),
        F.count_if(both & (F.col("raw") < 0)).alias("same_negative"))
    top = F.max(F.when(F.col("role") == base, F.col("mean_abs"))).over(Window.partitionBy(F.lit(1)))        # a row per role
    return m.withColumn("separation", F.when(F.col("role") != base, top - F.col("mean_abs")))


def fold_summary(per_fold: DataFrame, metrics: list[str], by: list[str] = []) -> DataFrame:
    """Mean and population sd over folds."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return per_fold.groupBy(*by).agg(*aggs)


def benjamini_hochberg(tests: DataFrame, p: str = "p", by: list[str] = [], order: list[str] = []) -> DataFrame:
    """Add ``q``.  A table of tests has one row per hypothesis (domains by scores), so
    ordering it per family is a small step; missing p-values get no q."""
    fam = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    known = tests.filter(F.col(p).isNotNull() & ~F.isnan(p))
    rest = tests.filter(F.col(p).isNull() | F.isnan(p)).withColumn("q", F.lit(None).cast("double"))
    r = known.withColumn("_rn", F.row_number().over(fam.orderBy(p, *order))).withColumn("_n", F.count("*").over(fam))
    up = fam.orderBy("_rn").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rn")).over(up))
    return r.withColumn("q", q).drop("_rn", "_n").unionByName(rest)


def diagnosis_or_person(reports: DataFrame, meta: DataFrame, person: Column) -> DataFrame:
    """Diagnosis by report id, else by person (the largest code wins), else ``NA``."""
    own = meta.select(F.col("code").alias("report_id"), F.col("dx").alias("_own"))
    pm = meta.withColumn("_p", person(F.col("code"))).groupBy("_p").agg(F.max_by("dx", "code").alias("_person"))
    r = reports.withColumn("_p", person(F.col("report_id")))
    j = r.join(own, "report_id", "left").join(pm, "_p", "left")
    return j.withColumn("dx", F.coalesce("_own", "_person", F.lit("NA"))).drop("_own", "_person", "_p")


def build_check(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest absolute difference of two builds aligned by key, and rows on one side only."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"),
                 F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"),
                 F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"))


def to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN to null ahead of a JSON sink."""
    for c in columns:
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text cells to doubles; missing and non-numeric cells become null."""
    for c in columns:
        df = df.withColumn(c, F.col(c).try_cast("double"))
    return df


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return coerce_numeric(df, columns).dropna(subset=columns)


def stability_table(bic: DataFrame, seeds: DataFrame, boot: DataFrame, bar: float = 0.8) -> DataFrame:
    """Per-k results side by side; k is a short list of settings."""
    j = bic.join(seeds, "k", "left").join(boot, "k", "left")
    return j.withColumn("stable", F.when(F.col("seed_ari_mean") >= bar, "yes").otherwise("no"))


def latest_run(df: DataFrame, run: str = "run") -> DataFrame:
    """Rows of the newest run by name; with ``run`` as a partition column this prunes files."""
    newest = df.agg(F.max(run).alias("_r"))
    return df.join(F.broadcast(newest), F.col(run) == F.col("_r")).drop("_r")
