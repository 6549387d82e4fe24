"""Balanced shards by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group that is never split.  Groups of a notable size are packed one
by one; the many small ones are first bundled by a hash of their text (a bundle holds whole groups), so
what the driver packs is bounded by parameters and never by the corpus.  Sorted by size, each item enters
the fullest bin that still has room, found in a balanced tree of remaining capacities.  For a given number
of shards the capacity itself is searched: the smallest one at which that many bins suffice.

Null texts count as empty, ties go by text hash, repeated rows keep their own slots, an empty table gives
an empty result, and columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compovec.llm.common import documents, gapless, materialise

BUNDLES_PER_SHARD = 256
#: A group of at least this share of a shard's even load is packed on its own.
NOTABLE = 1 / 256


class CapacityTree:
    """Ordered set of (remaining capacity, bin): a treap whose priorities come from the bin number."""

    def __init__(self) -> None:
        self.root: list | None = None        # [key, priority, left, right]

    @staticmethod
    def _split(node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = CapacityTree._split(node[3], key)
            return node, right
        left, node[2] = CapacityTree._split(node[2], key)
        return left, node

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = CapacityTree._merge(a[3], b)
            return a
        b[2] = CapacityTree._merge(a, b[2])
        return b

    def add(self, room: int, number: int) -> None:
        key = (room, number)
        left, right = self._split(self.root, key)
        node = [key, (number * 0x9E3779B97F4A7C15 + room * 0xC2B2AE3D27D4EB4F) & (2**64 - 1), None, None]
        self.root = self._merge(self._merge(left, node), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest (remaining, bin) with remaining >= size."""
        left, right = self._split(self.root, (size, -1))
        node = right
        while node is not None and node[2] is not None:
            node = node[2]
        if node is None:
            self.root = left
            return None
        first, rest = self._split(right, (node[0][0], node[0][1] + 1))
        self.root = self._merge(left, rest)
        return first[0]


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin of each item; an item larger than ``capacity`` gets a bin of its own."""
    bins, tree = 0, CapacityTree()
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_tightest(sizes[i])
        if found is None:
            room, number = max(capacity, sizes[i]), bins
            bins += 1
        else:
            room, number = found
        out[i] = number
        tree.add(room - sizes[i], number)
    return out


def balance(sizes: Sequence[int], shards: int, rounds: int = 24) -> list[int]:
    """Best fit decreasing into ``shards`` bins at the smallest capacity found by bisection."""
    if not sizes:
        return []
    total, largest = sum(sizes), max(sizes)
    low = max(-(-total // shards), largest)
    high = max(low, 2 * total // shards + largest)
    best = best_fit_decreasing(sizes, high)
    for _ in range(rounds):
        middle = (low + high) // 2
        tried = best_fit_decreasing(sizes, middle)
        if max(tried) < shards:
            best, high = tried, middle
        else:
            low = middle + 1
        if low >= high:
            break
    return best


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, size in bytes plus one, CRC-32 and a 128-bit key of each text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
                       F.unhex(F.md5(text)).alias("text_key"))


def shard(docs: DataFrame, shards: int = 16, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    With ``capacity`` the number of shards is whatever best fit decreasing needs; otherwise there are
    ``shards`` of them, as even in bytes as whole groups allow.
    """
    rows = materialise(fingerprints(docs), "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    even = capacity or -(-total // shards)
    wanted = max(shards, -(-total // even)) if even else shards
    bundles = BUNDLES_PER_SHARD * wanted
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("text_key"), F.lit(bundles)).cast("string"))
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"))
    # at most wanted / NOTABLE groups can be this large, and there are `bundles` bundles: both bounds are parameters
    unit = F.when(F.col("bytes") >= F.lit(max(1, int(even * NOTABLE))), F.hex("text_key")).otherwise(bundle)
    units = groups.groupBy(unit.alias("unit")).agg(F.sum("bytes").alias("bytes")).orderBy("unit").collect()
    sizes = [u["bytes"] for u in units]
    bins = best_fit_decreasing(sizes, capacity) if capacity else balance(sizes, shards)
    plan = docs.sparkSession.createDataFrame([(u["unit"], b) for u, b in zip(units, bins)], "unit string, shard int")
    notable = F.broadcast(plan.where(~F.col("unit").startswith("b")).select(F.unhex("unit").alias("text_key"), F.col("unit").alias("own")))
    placed = (rows.join(notable, "text_key", "left").withColumn("unit", F.coalesce("own", bundle)).drop("own")
              .join(F.broadcast(plan), "unit").select("doc_id", "size", "text_crc32", "shard", "text_key"))
    return gapless(placed, ["shard"], ["doc_id", "text_key"]).drop("text_key")


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; documents with equal texts share a shard."""
    out = shard(documents(spark, sf_dir), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_balanced_shards": op7_balanced_shards}
