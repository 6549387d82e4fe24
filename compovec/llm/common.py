"""Shared pieces of the training-data operators: Arrow batches of text, scratch tables, label samples, gapless ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compovec.session import materialise

__all__ = ["BATCH_BYTES", "documents", "gapless", "labelled", "map_texts", "materialise", "sample_by_hash", "slices", "spread_codes", "words"]

#: Text bytes that a task holds as Arrow at a time; a longer single text is a batch of its own.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: rows alone bound nothing where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of at most ``limit`` bytes of ``column`` (one row at least)."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < len(size):
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield b.slice(at, end - at)
            at = end


def map_texts(docs: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str, columns=("doc_id", "text")) -> DataFrame:
    """Apply ``fn`` to bounded Arrow slices of ``columns``; a map without a shuffle."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            out = fn(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return docs.select(*columns).mapInArrow(run, schema)


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Runs of characters other than ASCII white space: the row of each word, and the words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = pc.list_flatten(lists)
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(flat), 0)
    keep = some.to_numpy(zero_copy_only=False)
    return (rows, flat) if keep.all() else (rows[keep], flat.filter(some))


def sample_by_hash(df: DataFrame, key: str, bound: int, seed: int = 17) -> DataFrame:
    """About ``bound`` rows chosen by a hash of ``key``: the same rows however the input is split or recomputed."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < F.lit(int((1 << 30) * bound / n)))


def labelled(spark: SparkSession, sf_dir: str, target: str, fold: int, remainder: int) -> DataFrame:
    """Rows of ``labels`` that may be learnt from: ``crc32(doc_id) mod fold`` is not ``remainder`` and the label is 0 or 1."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(target).cast("int").alias("label"))
    return (rows.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"), fold, remainder))
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def is_held_out(doc_id, fold: int, remainder: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == remainder, F.lit(False))


def gapless(df: DataFrame, group: list[str], order: list[str], rows_per_task: int = 200_000) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each group, without ordering a whole group in one task.

    Rows of a group are dealt to splits by a hash of the order columns; splits are numbered
    by a running sum of their counts, rows within a split by a window.  The number of splits
    follows the row count, so a group of a third of all rows is shared by many tasks.
    """
    n = df.count()
    splits = max(1, -(-n // rows_per_task))
    dealt = df.withColumn("_split", F.pmod(F.xxhash64(*order), F.lit(splits)).cast("int"))
    counts = dealt.groupBy(*group, "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_split").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    return (ranked.join(starts, [*group, "_split"])
            .withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long")).drop("_split", "_start", "_rank"))


def spread_codes(raw: list[bytes], index: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the n + 1 offsets: ``raw`` has the 32-bit ids of each distinct word, ``index`` the words in order."""
    flat = np.frombuffer(b"".join(raw), "<u4")
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    start = np.cumsum(size) - size
    own = size[index] if len(raw) else np.zeros(0, np.int64)
    at = np.repeat(start[index] - (np.cumsum(own) - own), own) + np.arange(int(own.sum())) if len(raw) else np.zeros(0, np.int64)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(rows, own, n).astype(np.int64), out=offsets[1:])
    return flat[at], offsets
