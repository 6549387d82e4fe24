"""Random relabelings with exact group sizes by keyed permutations: a row computes its own place in every draw.

A draw permutes 0..n-1 by ``ROUNDS`` rounds of swap-or-not: with a key K, x and (K - x) mod n are partners, and one bit that both share
says whether they change places.  Every round is a bijection for any n, so group sizes are exact and no
row is repeated, ranked or shuffled per draw.  Groups of all draws are added up as products of 0/1 matrices with the
rows' values; a task returns draws x groups x values numbers, whatever its rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compovec.functions import arrays as A
from compovec.operators.bootstrap import TILE_CELLS, tile_sums
from compovec.operators.resample import hash_rank

ROUNDS, P = 20, 2**31 - 1
#: Rows that one ordering task gets, about, when rows are numbered.
ROWS_PER_BUCKET = 50_000
#: Draws of one tile.
TILE_DRAWS = 250


def round_keys(n_draws: int, n: int) -> np.ndarray:
    """(draws, rounds, 3): partner key, multiplier and shift of each round, from the digits of an md5."""
    out = np.empty((n_draws, ROUNDS, 3), np.int64)
    for b in range(n_draws):
        for r in range(ROUNDS):
            digest = hashlib.md5(f"{b}-{r}".encode()).hexdigest()
            k, a, c = (int(digest[i:i + 7], 16) for i in (0, 7, 14))
            out[b, r] = k % n, 1 + a, c
    return out


def places(i: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Place of the rows ``i`` in every draw, shape (rows, draws)."""
    x = np.repeat(i[:, None], len(keys), axis=1)
    for r in range(ROUNDS):
        k, a, c = keys[None, :, r, 0], keys[None, :, r, 1], keys[None, :, r, 2]
        partner = (k - x) % n
        x = np.where(((np.maximum(x, partner) * a + c) % P) & 1 == 1, partner, x)
    return x


def numbered(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """Rows with a dense number ``h`` in the hash order of their key; the buckets that are ordered apart follow the row count."""
    digits = max(1, math.ceil(math.log(max(n / ROWS_PER_BUCKET, 1), 16)))
    return hash_rank(df, [], key, F.lit("base"), digits=digits).withColumn("h", (F.col("pos") - 1).cast("long")).drop("pos", "pos_n")


def permuted_sums(df: DataFrame, vec: str, dim: int, sizes: list[int], key: list[str], n_draws: int) -> np.ndarray:
    """Sums (draws, groups, dim) of ``vec`` over random groups of these sizes."""
    n, groups = sum(sizes), len(sizes)
    bounds, keys = np.cumsum(sizes)[:-1], round_keys(n_draws, n)
    shared = df.sparkSession.sparkContext.broadcast(keys)
    starts = list(range(0, n_draws, TILE_DRAWS))

    def work(h: np.ndarray, x: np.ndarray, out: list[np.ndarray]) -> None:
        step = max(1, TILE_CELLS // TILE_DRAWS)
        for t, a in enumerate(starts):
            part = shared.value[a:a + TILE_DRAWS]
            total = out[t].reshape(len(part), groups, dim)
            for s in range(0, len(x), step):
                group = np.searchsorted(bounds, places(h[s:s + step].astype(np.int64), part, n), side="right")
                for g in range(groups):
                    total[:, g] += (group == g).T.astype(float) @ x[s:s + step]

    rows = numbered(df.select(*key, F.col(vec).alias("x")), key, n).select("h", "x")
    # every row is worked on once per draw, so few rows are not to be coalesced into few tasks
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    flat = tile_sums(rows, work, [len(keys[a:a + TILE_DRAWS]) * groups * dim for a in starts])
    shared.unpersist()
    return np.concatenate([v.reshape(-1, groups, dim) for v in flat])


def group_sizes(df: DataFrame, label: str) -> list[int]:
    return [r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).collect()]


def permuted_eta2(df: DataFrame, vec: str, dim: int, label: str, key: list[str], n_draws: int) -> DataFrame:
    """Between share under random relabelings with the same group sizes, one row (b, eta2) per draw; null without variance."""
    sizes = np.array(group_sizes(df, label), float)
    v = F.col(vec)
    t = df.agg(F.array(*[F.avg(F.get(v, F.lit(i))) for i in range(dim)]).alias("m"), F.count("*").alias("n")).first()
    if not t["n"]:
        return df.sparkSession.createDataFrame([], "b int, eta2 double")
    centred = df.select(*key, A.subtract(v, A.literal(np.array(t["m"]))).alias("_c"))        # large means do not cancel
    q = centred.agg(F.sum(A.dot(F.col("_c"), F.col("_c")))).first()[0]
    sums = permuted_sums(centred, "_c", dim, [int(s) for s in sizes], key, n_draws)
    eta2 = ((sums**2).sum(2) / sizes).sum(1) / q if q else np.full(n_draws, np.nan)
    return df.sparkSession.createDataFrame([(b, None if np.isnan(e) else float(e)) for b, e in enumerate(eta2)], "b int, eta2 double")


def permuted_rand(df: DataFrame, label: str, key: list[str], n_draws: int) -> DataFrame:
    """Adjusted Rand index of a labeling with its shuffles, one row (b, ari) per draw."""
    from compovec.operators.mixture import rand_from_table
    names = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    hot = F.array(*[F.col(label).eqNullSafe(F.lit(v)).cast("double") for v in names])
    tables = permuted_sums(df.select(*key, hot.alias("_hot")), "_hot", len(names), group_sizes(df, label), key, n_draws) if names else np.zeros((0, 1, 1))
    return df.sparkSession.createDataFrame([(b, rand_from_table(t)) for b, t in enumerate(tables)], "b int, ari double")
