"""Filter interaction audit: what each filter removes, repeats and shares with the others, in every order of application.

The order in which filters run changes only who gets the blame, so texts are judged once: a row's failures are a bit
mask, and every figure of every order is a sum over the counts of masks.

1. Duplicate prepass.  Each text's hash raises a few cells of a counting Bloom sketch, one sketch per task, saturating
   at two; sketches are merged block by block.  A text with any cell below two is unique for certain.  Only the others
   can be repeats, and only they are shuffled: grouped by their whole text for the smallest id.
2. Flags.  The text filters are column expressions; the duplicate flag joins back by id, so a text that a third of all
   rows copy never meets in one task (it is grouped with map-side combining and found again by the id of its first row).
3. Counts.  Rows add up per part, mask and label.  For filter f after the filters P: removed are masks with f and none of P,
   kept those with neither, redundant those with f and some of P.  A mask of b filters loses its row to each of
   them in 1/b of all orders, which gives the Shapley sums.

The sketch has eight to sixteen cells a row, at most ``MOST_CELLS``; the driver holds one bit per cell (32 MB at most).  Beyond
that more unique texts count as possible repeats and are grouped needlessly; results are exact at every size.

Null text counts as empty, null part as the empty string.  A row without an id is nobody's earlier row and no later row.
Repeated rows of one id count each and are not duplicates of each other.  Very long texts are judged whole.  Several labels of one id count as
good or toxic if any of them is.  An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compovec.llm.common import documents
from compovec.llm.doc_stats import mix

#: Cells a text raises.
PROBES = 4
#: Cells of one block of the sketch, and of the largest sketch.
BLOCK, MOST_CELLS = 1 << 16, 1 << 28
#: Texts whose cells a task gathers before it sends them on.
GATHER = 1 << 18

SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """The four filters that look at one text: few words, few different words, many capitals, symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    return {"A": count < 200, "B": 100 * distinct < 50 * count,
            "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


# ---- the sketch

def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each text, one row per probe; a text's cells differ, since the step is odd and ``cells`` a power of two."""
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes
    first, step = mix(h), mix(h ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) & np.uint64(cells - 1) for i in range(PROBES)])


def sketch_rows(hashes: np.ndarray, cells: int) -> pa.RecordBatch:
    """Cells raised once and cells raised more often, as positions inside their block."""
    texts, n = np.unique(hashes, return_counts=True)
    at = cells_of(texts, cells)
    cell, index = np.unique(at, return_inverse=True)
    count = np.bincount(index.ravel(), np.tile(np.minimum(n, 2), PROBES))
    often = count > 1
    block, low = (cell // BLOCK).astype(np.int64), (cell % BLOCK).astype("<u2")
    blocks, starts = np.unique(block, return_index=True)
    once, more = [], []
    for a, e in zip(starts, np.append(starts[1:], len(block))):
        once.append(low[a:e][~often[a:e]].tobytes())
        more.append(low[a:e][often[a:e]].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["block", "once", "more"])


def merge_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of the merged sketch: a bit for each cell that two texts or more raised."""
    count = np.zeros(BLOCK, np.uint8)
    for b in batches:
        for once, more in zip(b.column("once").to_pylist(), b.column("more").to_pylist()):
            at = np.frombuffer(once, "<u2")
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(more, "<u2")] = 2
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], names=["block", "bits"])


def repeated_cells(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits of the cells that at least two texts raise; ``hashes`` has one column, ``hash``."""
    cells = min(MOST_CELLS, max(BLOCK, 1 << (8 * n - 1).bit_length()))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b.column("hash").to_numpy(zero_copy_only=False))
            size += b.num_rows
            if size >= GATHER:
                yield sketch_rows(np.concatenate(held), cells)
                held, size = [], 0
        if size:
            yield sketch_rows(np.concatenate(held), cells)

    raised = hashes.select("hash").mapInArrow(sketch, "block long, once binary, more binary")
    merged = raised.groupBy("block").applyInArrow(merge_block, "block long, bits binary")
    bits = np.zeros((cells // BLOCK, BLOCK // 8), np.uint8)
    for row in merged.toLocalIterator():                  # a bit per cell, MOST_CELLS / 8 bytes at most
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def possible_repeat(spark: SparkSession, bits: np.ndarray):
    """A vectorised test of text hashes: false for texts that are unique for certain."""
    shared, cells = spark.sparkContext.broadcast(bits), 8 * len(bits)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        at, table = cells_of(h.to_numpy(np.int64), cells), shared.value
        return pd.Series(((table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=0))

    return test


# ---- flags and counts

def masks(docs: DataFrame, part: Column, filters: dict[str, Column] | None = None) -> DataFrame:
    """Rows (doc_id, part, mask, rows): bit i of the mask is the i-th text filter, the next bit a text equal to that of a smaller id."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    filters = text_filters(text) if filters is None else filters
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("body"),
                         reduce(Column.__add__, (F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(filters.values()))).alias("mask"),
                         F.xxhash64(text).alias("hash"), F.xxhash64(F.lit(1), text).alias("check"))
    test = possible_repeat(spark, repeated_cells(hashed.select("hash"), docs.count()))
    maybe = F.col("doc_id").isNotNull() & test("hash")
    texts = hashed.select("doc_id", "body", "hash", "check").where(maybe).groupBy("body").agg(
        F.min("doc_id").alias("doc_id"), F.first("hash").alias("hash"), F.first("check").alias("check"))
    # a text's first row, known by its id and two hashes of its text; ids are spread evenly, a copied text is not
    firsts = texts.select("doc_id", "hash", "check").withColumn("is_first", F.lit(True))
    rows = hashed.select("doc_id", "part", "mask", "hash", "check").withColumn("maybe", maybe)
    rows = rows.select("doc_id", "part", "mask", "maybe", *[F.when(F.col("maybe"), F.col(c)).alias(c) for c in ("hash", "check")])
    rows = rows.groupBy("doc_id", "part", "mask", "maybe", "hash", "check").agg(F.count(F.lit(1)).alias("rows"))     # repeated rows of an id, rows without one
    again = F.when(F.col("maybe") & F.col("is_first").isNull(), 1 << len(filters)).otherwise(0)
    return (rows.join(firsts, ["doc_id", "hash", "check"], "left")
            .select("doc_id", "part", (F.col("mask") + again).cast("int").alias("mask"), "rows"))


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """Every order of the filters by step: the filter's bit and the bits of the filters before it; a table of fixed size."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    rows = [("".join(o), i + 1, bit[c], sum(bit[x] for x in o[:i])) for o in permutations(letters) for i, c in enumerate(o)]
    return spark.createDataFrame(rows, "filter_order string, step int, own int, before int")


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """Counts of every order and step from rows (part, mask, rows, good, toxic), one per part and mask."""
    spark, n = counts.sparkSession, len(letters)
    full = (1 << n) - 1
    cases = [(1 << i, p) for i in range(n) for p in range(full + 1) if not p >> i & 1]
    case = F.explode(F.array(*[F.struct(F.lit(f).alias("own"), F.lit(p).alias("before")) for f, p in cases]))      # n * 2 ** (n - 1) of them
    each = counts.select("*", case.alias("case")).select("part", "mask", "rows", "good", "toxic", "case.own", "case.before")
    fails, passed = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    order_count = len(list(permutations(letters)))

    def total(when: Column, what: str | Column = "rows") -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(what) if isinstance(what, str) else what)), F.lit(0)).cast("long")

    sums = each.groupBy("part", "own", "before").agg(
        total(~fails & passed).alias("kept"), total(fails & passed).alias("removed"), total(fails & ~passed).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & passed, "good").alias("good_lost"),
        total(fails & passed, "toxic").alias("toxic_lost"), total(fails, F.col("rows") * order_count / F.bit_count("mask")).alias("shapley"))
    return sums.join(F.broadcast(orders(spark, letters)), ["own", "before"]).drop("own", "before")


def interactions(docs: DataFrame, labels: DataFrame, part: str = "source", letters: str = "ABCDE") -> DataFrame:
    """The audit of ``docs`` by the values of ``part``, with ``labels`` (doc_id, quality, toxic)."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    judged = masks(docs, F.coalesce(docs[part].cast("string"), F.lit(""))).join(known, "doc_id", "left")
    count = lambda c: F.sum(F.col("rows") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    counts = judged.groupBy("part", "mask").agg(count("good"), count("toxic"), F.sum("rows").alias("rows"))
    return audit(counts, letters)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all orders, by source."""
    out = interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


QUERIES = {"op13_filter_audit": op13_filter_audit}

ORACLE_SQL = {"op13_filter_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
masks AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m
  FROM split),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, m, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM masks LEFT JOIN known USING (doc_id)),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)),
perms AS (
  SELECT [a.c, b.c, c.c, d.c, e.c] AS cs, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a JOIN letters b ON a.bit <> b.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit)
  JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
steps AS (
  SELECT array_to_string(cs, '') AS filter_order, s AS step, bits[s] AS f, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS p
  FROM perms, range(1, 6) r(s)),
counts AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, m)
SELECT part, filter_order, step::INT AS step,
       coalesce(sum(n) FILTER (m & (p | f) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (m & f > 0 AND m & p = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (m & f > 0 AND m & p > 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (m = f), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (m & f > 0 AND m & p = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (m & f > 0 AND m & p = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(m::INT), 1)) FILTER (m & f > 0), 0)::BIGINT AS shapley
FROM counts, steps GROUP BY part, filter_order, step
"""}
