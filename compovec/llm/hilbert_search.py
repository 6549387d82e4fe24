"""Approximate nearest neighbours by inner product with shifted space-filling curves.

Each of ``ORDERINGS`` random projections (each with its own shift of the grid) orders all vectors along a Hilbert
curve; the order is cut into key ranges of nearly equal counts, a query meets the ranges within its window in every
ordering, and the best of all windows are merged and ranked by the exact inner product.

Vectors are first lifted by one coordinate that gives them equal norms, so the largest inner product is the nearest
point.  The window is a share of all vectors: on vectors without structure (isotropic, 64 dimensions) a narrower one
cannot reach the recall asked for, on clustered data a smaller ``WINDOW`` will do.  Key ranges hold at most about
``RANGE_ROWS`` rows, so a task's memory does not grow with the table.  Small tables have fewer ranges, down to one,
and the window never falls below its share: a query always meets far more than ``k`` candidates, or all of them.

Of equal vectors only the ``k`` + 1 smallest ids can be among anybody's nearest ``k``; the others stay queries but
leave the candidates, which removes hot vectors without changing a result.  Vectors that are null, zero, of another
length than the most common one, or with null or non-finite components take no part; repeated rows count once;
an empty table gives an empty result; columns other than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compovec.llm.common import materialise

ORDERINGS = 12
DIMENSIONS = 4
BITS = 10
#: Share of all vectors that one window of one ordering covers.
WINDOW = 0.14
RANGE_ROWS = 20_000
#: A key range of a small table holds at least so many times k + 1 rows; a table of less is one range.
LEAST_TIMES = 5
SEED = 20


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, the vector as 64-bit floats in bytes, its length and squared norm; unusable vectors are left out."""
    def run(batches):
        for b in batches:
            col = b.column("embedding")
            flat = pc.cast(pc.list_flatten(col), pa.float64())
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
            end = np.cumsum(size)
            ids, out, norms = [], [], []
            for vec_id, a, e in zip(b.column("vec_id").to_pylist(), (end - size).tolist(), end.tolist()):
                v = values[a:e]
                norm = float(v @ v) if e > a else 0.0
                if vec_id is not None and 0 < norm < float("inf"):
                    ids.append(vec_id)
                    out.append(v.tobytes())
                    norms.append(norm)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array([len(v) // 8 for v in out], pa.int32()),
                                              pa.array(norms, pa.float64())], names=["vec_id", "vec", "dim", "norm2"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vec binary, dim int, norm2 double")


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer grid points along the Hilbert curve (transpose form of the coordinates, then interleaved)."""
    x = grid.T.astype(np.int64).copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            inverted = (x[i] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> bit) & 1)
    return key


class Curves:
    """The projections, and the keys they give."""

    def __init__(self, dim: int, longest2: float, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.longest2 = longest2
        self.axes = [np.linalg.qr(rng.standard_normal((dim + 1, min(DIMENSIONS, dim + 1))))[0] for _ in range(ORDERINGS)]
        self.shifts = [rng.random(a.shape[1]) for a in self.axes]
        #: spread of a projected coordinate of a unit vector in this many dimensions
        self.scale = 1 / np.sqrt(dim + 1)

    def keys(self, x: np.ndarray, query: bool = False) -> list[np.ndarray]:
        """Keys in every ordering.  A candidate is lifted to the sphere of the longest vector, a query lies in the plane below."""
        unit = np.sqrt(self.longest2)
        if query:
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            lifted = np.hstack([x / length, np.zeros((len(x), 1))])
        else:
            rest = np.sqrt(np.maximum(self.longest2 - (x * x).sum(axis=1), 0))
            lifted = np.hstack([x, rest[:, None]]) / unit
        out = []
        for axes, shift in zip(self.axes, self.shifts):
            # the grid covers four spreads on each side and is moved by up to one cell of its coarsest level
            place = (lifted @ axes / self.scale + 4) / 8
            grid = np.clip((place * 0.75 + shift * 0.25) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            out.append(hilbert(grid, BITS))
        return out


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(-1, dim)


def dots(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * c[:, d]
    return total


def best_in_range(k: int, dim: int):
    """Per query of a key range its ``k`` nearest candidates of that range."""
    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy()
        queries, cands = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        none = pa.table({"query_id": pa.array([], pa.int64()), "near": pa.array([], NEAR)})
        if not queries.num_rows or not cands.num_rows:
            return none
        order = np.argsort(cands.column("vec_id").to_numpy(), kind="stable")
        cid, qid = cands.column("vec_id").to_numpy()[order], queries.column("vec_id").to_numpy()
        c, q = vectors_of(cands.column("vec"), dim)[order], vectors_of(queries.column("vec"), dim)
        out_ids, out_near = [], []
        for at in range(0, len(q), 512):
            part, own = q[at:at + 512], qid[at:at + 512]
            score = part @ c.T
            score[own[:, None] == cid[None, :]] = -np.inf
            take = min(k + 8, len(c))                                  # a margin for sums that differ in the last bits
            rows = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < len(c) else np.tile(np.arange(len(c)), (len(part), 1))
            exact = dots(np.repeat(part, take, axis=0), c[rows.ravel()]).reshape(rows.shape)
            for i in range(len(part)):
                ids = cid[rows[i]]
                best = np.lexsort((ids, -exact[i]))
                best = best[ids[best] != own[i]][:k]
                out_ids.append(int(own[i]))
                out_near.append([{"minus": -float(exact[i][j]), "vec_id": int(ids[j])} for j in best])
        return pa.table({"query_id": pa.array(out_ids, pa.int64()), "near": pa.array(out_near, NEAR)})
    return run


NEAR = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())]))


def ranges_and_reach(n: int, k: int, window: float) -> tuple[int, int]:
    """Number of key ranges, and how many a window reaches to each side of its own: 2 reach + 1 ranges are no less than the window."""
    reach = 2
    while int((2 * reach + 1) / window) * RANGE_ROWS < n:
        reach += 1
    ranges = max(1, min(int((2 * reach + 1) / window), n // (LEAST_TIMES * (k + 1))))
    return ranges, max(1, math.ceil((window * ranges - 1) / 2 - 1e-9))


def search(vectors: DataFrame, k: int = 20, every: int = 20, window: float = WINDOW) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = materialise(packed(vectors), "vectors")
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dim = common["dim"]
    rows = rows.where(F.col("dim") == dim)
    longest2 = rows.agg(F.max("norm2")).first()[0]
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vec").dropDuplicates()
    same = Window.partitionBy("vec").orderBy("vec_id")
    cands = rows.select("vec_id", "vec").dropDuplicates().withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n")
    curves = Curves(dim, longest2)

    def keyed(is_query: bool):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    keys = np.stack(curves.keys(vectors_of(b.column("vec"), dim), is_query), axis=1)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), lists], names=["vec_id", "vec", "keys"])
        return run

    schema = "vec_id long, vec binary, keys array<long>"
    cands = materialise(cands.mapInArrow(keyed(False), schema), "curve-keys")
    n = cands.count()
    ranges, reach = ranges_and_reach(n, k, window)
    shares = [i / ranges for i in range(1, ranges)]
    cuts = cands.agg(*[F.percentile_approx(F.col("keys")[s], shares, 20 * ranges).alias(f"c{s}") for s in range(ORDERINGS)]).first() if shares else [None] * ORDERINGS
    cuts = [np.array(cuts[s] or [], np.int64) for s in range(ORDERINGS)]

    def dealt(is_query: bool):
        """Candidates go to their range of every ordering, queries to the ranges of their windows."""
        def run(batches):
            for b in batches:
                keys = np.array(b.column("keys").to_pylist(), np.int64).reshape(b.num_rows, ORDERINGS)
                for s in range(ORDERINGS):
                    low, high = np.searchsorted(cuts[s], keys[:, s], side="left"), np.searchsorted(cuts[s], keys[:, s], side="right")
                    if not is_query:
                        # equal keys that fill several ranges are spread over them by id
                        at = low + pd.util.hash_array(b.column("vec_id").to_numpy()).astype(np.int64) % (high - low + 1)
                        yield made(b, s, at, np.arange(b.num_rows), False)
                        continue
                    first, last = np.maximum(low - reach, 0), np.minimum(high + reach, ranges - 1)
                    # at an end of the curve the window moves inwards
                    first, last = np.minimum(first, np.maximum(ranges - 1 - 2 * reach, 0)), np.maximum(last, np.minimum(2 * reach, ranges - 1))
                    count = last - first + 1
                    row = np.repeat(np.arange(b.num_rows), count)
                    yield made(b, s, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count), row, True)
        return run

    def made(b, s, at, row, is_query):
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), s), pa.int32()), pa.array(at, pa.int32()), b.column("vec_id").take(take), b.column("vec").take(take),
                                           pa.array(np.full(len(row), is_query))], names=["ordering", "range", "vec_id", "vec", "is_query"])

    schema2 = "ordering int, range int, vec_id long, vec binary, is_query boolean"
    asked = queries.mapInArrow(keyed(True), schema).mapInArrow(dealt(True), schema2)
    both = cands.mapInArrow(dealt(False), schema2).unionByName(asked)
    found = both.groupBy("ordering", "range").applyInArrow(best_in_range(k, dim), "query_id long, near array<struct<minus:double,vec_id:long>>")
    merged = found.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    out = merged.select("query_id", F.posexplode("near").alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def op10_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_hilbert_search": op10_hilbert_search}
