"""Resampling by hash order: draws depend on keys only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 3        # hex digits of the hash that form a bucket: 4096 per draw


def draws(df: DataFrame, n: int, name: str = "b", first: int = 0) -> DataFrame:
    """Rows repeated for every draw number 0..n-1, or for n numbers from ``first`` on."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))


def hash_key(*parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]))


def random_k(df: DataFrame, k: int, n_draws: int, group: list[str], key: list[str]) -> DataFrame:
    """``k`` rows per group and draw without replacement, ranked by hash.

    The rank filter is applied inside every map task before the exchange, so a
    hot group contributes at most ``k`` rows per task and draw.
    """
    d = draws(df, n_draws).withColumn("_h", F.unhex(hash_key("b", *group, *key)))       # half the bytes, the same order
    w = Window.partitionBy(*group, "b").orderBy("_h")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_h")


def hash_groups(df: DataFrame, sizes: list[int], n_draws: int, key: list[str], name: str = "grp") -> DataFrame:
    """Random groups of exact sizes in every draw: rows in hash order get group 0, 1, ...

    A histogram of hash prefixes finds, per draw, the buckets that hold the
    group borders.  Rows elsewhere know their group from their prefix alone;
    only border buckets (one 4096th of the rows each) are ordered.
    """
    bounds = []
    for s in sizes[:-1]:
        bounds.append((bounds[-1] if bounds else 0) + s)
    e = draws(df, n_draws).withColumn("_h", hash_key("b", *key)).withColumn("_p", F.substring("_h", 1, PREFIX))
    if not bounds:
        return e.withColumn(name, F.lit(0)).drop("_h", "_p")
    hist = e.groupBy("b", "_p").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("b").orderBy("_p"))
    hist = hist.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c"))
    # the border of a group is its last rank; at most len(sizes)-1 buckets per draw
    borders = hist.groupBy("b").agg(F.array(*[
        F.min(F.when(F.col("_upto") >= c, F.struct("_p", "_before"))) for c in bounds]).alias("_e"))
    # one row per draw: a parameter of the call bounds the broadcast
    j = e.join(F.broadcast(borders), "b")
    on_border = F.exists("_e", lambda x: x["_p"] == F.col("_p"))
    passed = F.size(F.filter("_e", lambda x: x["_p"] < F.col("_p")))
    clear = j.filter(~on_border).withColumn(name, passed)
    inside = F.row_number().over(Window.partitionBy("b", "_p").orderBy("_h", *key))
    before = F.filter("_e", lambda x: x["_p"] == F.col("_p"))[0]["_before"]
    rank = before + inside
    limits = F.array(*[F.lit(int(c)) for c in bounds])
    tight = j.filter(on_border).withColumn("_rank", rank)
    tight = tight.withColumn(name, F.size(F.filter(limits, lambda c: c < F.col("_rank")))).drop("_rank")
    return clear.unionByName(tight).drop("_h", "_p", "_e")


def hash_rank(df: DataFrame, by: list[str], key: list[str], salt: Column, name: str = "pos", digits: int = 2) -> DataFrame:
    """1-based position of every row in the hash order of its group, plus the group size ``<name>_n``.

    Hash prefixes split a group into equal buckets that are ordered apart and
    shifted by the counts before them, so no task sees a whole group.
    """
    d = df.withColumn("_h", hash_key(salt, *by, *key)).withColumn("_p", F.substring("_h", 1, digits))
    hist = d.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    hist = hist.withColumn("_n", F.sum("_c").over(w)).withColumn("_upto", F.sum("_c").over(w.orderBy("_p")))
    hist = hist.select(*by, "_p", F.col("_n").alias(f"{name}_n"), (F.col("_upto") - F.col("_c")).alias("_before"))
    j = d.join(hist, by + ["_p"])
    inside = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", *key))
    return j.withColumn(name, inside + F.col("_before")).drop("_h", "_p", "_before")


def halves(df: DataFrame, group: list[str], key: list[str], seed: int = 0) -> DataFrame:
    """Split every group's rows into two halves, the first of size floor(n / 2), in hash order."""
    r = hash_rank(df, group, key, F.lit(seed))
    return r.withColumn("half", F.when(F.col("pos") <= F.floor(F.col("pos_n") / 2), 1).otherwise(2)).drop("pos", "pos_n")


def shuffled_pairs(left: DataFrame, right: DataFrame, key: list[str], n_draws: int, first: int = 0) -> DataFrame:
    """Every draw pairs the rows of ``left`` with a random permutation of the rows of ``right``.

    A draw depends on its number alone, so a caller may take ``n_draws`` draws from ``first`` on at a time.  Both sides are rows times draws, which the optimizer's size estimate does not
    see, so the join is a merge: broadcast, one side would pass through the driver.
    """
    a = draws(hash_rank(left, [], key, F.lit("base")).drop("pos_n"), n_draws, first=first)
    b = hash_rank(draws(right, n_draws, first=first), ["b"], key, F.lit("perm")).drop("pos_n", *key)
    return a.hint("merge").join(b, ["b", "pos"]).drop("pos")


def weighted_k(df: DataFrame, weight: str, k: int, group: list[str], key: list[str], seed: int = 0) -> DataFrame:
    """``k`` rows per group, weight-proportional without replacement, short groups padded with the last pick.

    Each row draws an exponential key ``-ln(u) / w`` from its hash and the
    smallest keys win; a group whose weights are all zero is sampled uniformly.
    """
    u = (F.conv(F.substring(hash_key(F.lit(seed), *group, *key), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16 ** 12 + 1))
    any_weight = df.groupBy(*group).agg(F.max(F.coalesce(weight, F.lit(0.0))).alias("_max"))
    d = df.join(any_weight, group).withColumn("_w", F.when(F.col("_max") > 0, F.col(weight)).otherwise(F.lit(1.0)))
    d = d.filter(F.col("_w") > 0).withColumn("_x", -F.ln(u) / F.col("_w")).drop("_max", "_w")
    w = Window.partitionBy(*group).orderBy("_x", *key)
    top = d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_x")
    last = F.max("rank").over(Window.partitionBy(*group))
    extra = F.when(F.col("rank") == last, F.sequence(F.col("rank"), F.lit(k))).otherwise(F.array(F.col("rank")))
    return top.withColumn("_r", extra).withColumn("rank", F.explode("_r")).drop("_r")
