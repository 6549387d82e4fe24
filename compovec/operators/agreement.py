"""Agreement between label sets and between votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compovec.functions import arrays as A
from compovec.sources import ontology

KEYS = ["report_id", "sentence_idx"]
NONE = "(none)"   # fixed value: category of a vote without a label


def paired_sets(gold: DataFrame, silver: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Gold and silver label sets of the keys both sides have; one exchange.

    Sets are bounded by the number of domains and built map-side first.
    """
    both = gold.select(*keys, F.col("domain_id").alias("g"), F.lit(None).cast("string").alias("s")).unionAll(
        silver.select(*keys, F.lit(None).cast("string").alias("g"), F.col("domain_id").alias("s")))
    sets = both.groupBy(*keys).agg(F.collect_set("g").alias("gold"), F.collect_set("s").alias("silver"))
    return sets.filter((F.size("gold") > 0) & (F.size("silver") > 0))


def counts(paired: DataFrame, domains: list[str]) -> DataFrame:
    """tp, fp, fn, support per domain; domains without any case come as zero rows."""
    d = paired.select("gold", "silver", F.explode_outer(F.array_union("gold", "silver")).alias("domain_id"))
    d = d.filter(F.col("domain_id").isin(*domains))
    in_g, in_s = F.array_contains("gold", F.col("domain_id")), F.array_contains("silver", F.col("domain_id"))
    c = d.groupBy("domain_id").agg(
        F.count_if(in_g & in_s).alias("tp"), F.count_if(~in_g & in_s).alias("fp"),
        F.count_if(in_g & ~in_s).alias("fn"), F.count_if(in_g).alias("support"))
    base = paired.sparkSession.createDataFrame([(i, x) for i, x in enumerate(domains)], "ord int, domain_id string")
    return base.join(c, "domain_id", "left").fillna(0, ["tp", "fp", "fn", "support"])


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_domain(c: DataFrame, digits: int | None = 4) -> DataFrame:
    """Precision, recall and F1 per domain with a zero guard."""
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = c.withColumn("precision", p).withColumn("recall", r)
    out = out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    if digits is not None:
        for name in ("precision", "recall", "f1"):
            out = out.withColumn(name, F.round(F.round(name, 12), digits))
    return out


def set_scores(paired: DataFrame, n_domains: int, domains: list[str]) -> DataFrame:
    """Exact-set accuracy and Hamming loss over the common keys."""
    same = F.array_sort("gold") == F.array_sort("silver")
    known = F.array(*[F.lit(d) for d in domains])
    g, s = F.array_intersect("gold", known), F.array_intersect("silver", known)
    off = F.size(F.array_except(g, s)) + F.size(F.array_except(s, g))
    t = paired.agg(F.count("*").alias("n"), F.count_if(same).alias("exact"), F.sum(off).alias("off"))
    return t.select("n", _ratio(F.col("exact"), F.col("n")).alias("subset_accuracy"),
                    _ratio(F.coalesce("off", F.lit(0)), F.col("n") * n_domains).alias("hamming_loss"))


def roll_up(per: DataFrame) -> DataFrame:
    """Macro over supported domains, macro over all, weighted and micro averages; one row."""
    sup = F.col("support") > 0
    g = per.agg(
        *[F.avg(F.when(sup, F.col(m))).alias(f"macro_supported_{m}") for m in ("precision", "recall", "f1")],
        F.avg("f1").alias("macro_all_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        _ratio(F.sum("tp"), F.sum("tp") + F.sum("fp")).alias("micro_precision"),
        _ratio(F.sum("tp"), F.sum("tp") + F.sum("fn")).alias("micro_recall"))
    g = g.withColumn("micro_f1", _ratio(2 * F.col("micro_precision") * F.col("micro_recall"),
                                        F.col("micro_precision") + F.col("micro_recall")))
    return g.fillna(0.0)


def cooccurrence(paired: DataFrame, domains: list[str]) -> DataFrame:
    """Every gold label against every silver label of the same sentence.

    Both sets are bounded by the ontology, so the product stays inside the row.
    """
    known = F.array(*[F.lit(d) for d in domains])
    p = paired.select(F.array_intersect("gold", known).alias("gold"), F.array_intersect("silver", known).alias("silver"))
    p = p.select("silver", F.explode_outer("gold").alias("gold_id"))
    p = p.select("gold_id", F.explode_outer("silver").alias("silver_id")).filter("gold_id is not null and silver_id is not null")
    return p.groupBy("gold_id", "silver_id").agg(F.count("*").alias("n"))


def primary(items: DataFrame, keys: list[str], confidence: str = "confidence", pos: str = "pos") -> DataFrame:
    """The most confident label of a key, the first one on ties."""
    return items.groupBy(*keys).agg(
        F.max_by("domain_id", F.struct(F.coalesce(confidence, F.lit(0.0)), -F.col(pos))).alias("primary_id"),
        F.max(F.coalesce(confidence, F.lit(0.0))).alias("confidence"))


def vote_primaries(parsed: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Primary domain of every vote or the none category, null for failed votes; in-row, no exchange."""
    domains = ontology.ids() if domains is None else domains
    def better(acc, x):
        return F.when(acc.isNull() | (x["confidence"] > acc["confidence"]), x).otherwise(acc)
    first = F.aggregate("items", F.lit(None).cast("struct<domain_id:string,domain_code:string,confidence:double,rationale:string>"), better)
    rows = parsed.select(*KEYS, "vote_no", "error", first["domain_id"].alias("_d"))
    # failed votes keep a null vote instead of being filtered: a filter on the
    # computed error would be pushed down and parse every response again
    vote = F.when(F.col("error").isNull(), F.when(F.col("_d").isin(*domains), F.col("_d")).otherwise(F.lit(NONE)))
    return rows.select(*KEYS, "vote_no", vote.alias("vote"))


def vote_table(primaries: DataFrame, domains: list[str] | None = None, n_votes: int = 5) -> DataFrame:
    """Vote counts per sentence over the fixed categories; only complete sentences.

    One aggregation of conditional counts; modal and squared counts are in-row.
    """
    cats = (ontology.ids() if domains is None else domains) + [NONE]
    cols = [F.count_if(F.col("vote") == c) for c in cats]
    t = primaries.groupBy(*KEYS).agg(F.array(*cols).alias("counts"), F.count("vote").alias("n_votes"))
    t = t.filter(F.col("n_votes") == n_votes)
    valid = F.slice("counts", 1, len(cats) - 1)
    n_valid = F.col("n_votes") - F.get("counts", F.lit(len(cats) - 1))
    return t.select(*KEYS, "counts", "n_votes", F.array_max("counts").alias("modal"), n_valid.alias("n_valid"),
                    F.when(n_valid > 0, F.array_max(valid) / n_valid).alias("modal_valid"))


def fleiss_kappa(table: DataFrame, n_categories: int, n_votes: int = 5) -> DataFrame:
    """Fleiss' kappa over equally many votes per sentence; one row."""
    sumsq = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c * c)
    g = table.agg(F.count("*").alias("n"), F.sum(sumsq).alias("sq"),
                  F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(n_categories)]).alias("per_cat"))
    n, r = F.nullif(F.col("n").cast("double"), F.lit(0.0)), float(n_votes)
    p_bar = (F.col("sq") - n * r) / (n * r * (r - 1))
    p_e = A.total(F.transform("per_cat", lambda c: (c / (n * r)) * (c / (n * r))))
    return g.select("n", p_bar.alias("observed"), p_e.alias("expected"),
                    F.when(1 - p_e > 0, (p_bar - p_e) / (1 - p_e)).alias("kappa"))


def modal_agreement(table: DataFrame, by: list[str] = [], n_votes: int = 5) -> DataFrame:
    """Modal agreement with and without abstentions, unanimity, majority and split rates."""
    n = F.count("*")
    return table.groupBy(*by).agg(
        n.alias("n"), (F.avg("modal") / n_votes).alias("mean_modal"), F.avg("modal_valid").alias("mean_modal_valid"),
        (F.count_if(F.col("modal") == n_votes) / n).alias("unanimity"),
        (F.count_if((F.col("modal") >= 3) & (F.col("modal") < n_votes)) / n).alias("majority"),
        (F.count_if(F.col("modal") < 3) / n).alias("split"))


def confusion(pairs: DataFrame, gold: str, silver: str, domains: list[str]) -> DataFrame:
    """Gold by silver counts as a matrix in ontology order."""
    cells = [F.count_if(F.col(silver) == d).alias(d) for d in domains]
    return pairs.filter(F.col(gold).isin(*domains)).groupBy(gold).agg(*cells)


def contingency(df: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by, a, b).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency table."""
    t = contingency(df, a, b, by)
    pairs = lambda x: x * (x - 1) / 2
    cells = t.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("index"), F.sum("n").alias("total"))
    rows = t.groupBy(*by, a).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(pairs(F.col("m"))).alias("sa"))
    cols = t.groupBy(*by, b).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(pairs(F.col("m"))).alias("sb"))
    key = by or ["_k"]
    if not by:
        cells, rows, cols = (x.withColumn("_k", F.lit(1)) for x in (cells, rows, cols))
    j = cells.join(rows, key).join(cols, key)
    expected = F.col("sa") * F.col("sb") / F.nullif(pairs(F.col("total")), F.lit(0.0))
    top = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(top == expected, F.lit(1.0)).otherwise((F.col("index") - expected) / (top - expected))
    return j.select(*by, F.col("total").alias("n"), ari.alias("ari"))
