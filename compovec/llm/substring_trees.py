"""Substring dedup with prefix-partitioned suffix trees over words.

A window is ``WINDOW`` consecutive words; it is a repeat where the same words stand in a document with a smaller id.

1. Anchors.  Of the 8-word prefixes inside a window the one with the least hash (the leftmost of equal ones) is its anchor, so
   equal windows have equal anchors at equal offsets.  Neighbouring windows mostly share one: a document becomes a row of
   segments, each the windows of one anchor and their words, about one for every 22 words.
2. Equal segments are one class from here on, known by the hashes of anchor and words, with its smallest id; a passage
   that a third of all documents share is a few classes.  An anchor with one class needs no tree: all its windows are as old as the class.
3. Prefix partition.  The suffixes of the other classes are dealt to groups by their prefix, many anchors to a group of about
   ``GROUP_WORDS`` words.  An anchor with too many classes is split by longer prefixes of its windows, ``LENGTHS`` words; what is
   still too large there is keyed by the whole window, one node, and reduced by an aggregation with map-side combining.
4. Each group's suffix tree is built in memory as sorted suffixes and the depths of their branchings.  The topmost internal nodes
   of depth ``WINDOW`` or more are the repeats; the smallest id below such a node is the window's first document.
5. Verdicts return to the segments, spans to their documents.  Keys with more than a 4096th of all rows, at most 4096 of them, are
   joined by broadcast, the rest by a shuffle.

Words are compared by 64-bit hashes.  Null text has no words.  A document without an id is nobody's earlier document and loses
nothing.  Repeated rows of one id do not count as earlier documents of each other; each row has its own result.  Texts of
fewer words than a window stay; very long ones are judged whole.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compovec.llm.common import documents, map_texts, materialise, words
from compovec.llm.doc_stats import mix

WINDOW, GRAM = 50, 8
#: Words of the segments that one tree is built from, about, and classes of one anchor that go to one tree.
GROUP_WORDS, GROUP_CLASSES = 1 << 19, 4096
#: Lengths of the prefixes that split the windows of an anchor with more classes.
LENGTHS = (16, 32)
#: A key is joined by broadcast if it has at least this part of all rows.
HOT_PART = 4096
#: Ids that may be broadcast to filter documents; beyond that they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


# ---- segments

def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and 64-bit hash of every word, and the words."""
    rows, flat = words(pc.fill_null(texts, ""))
    codes = flat.dictionary_encode()
    known = codes.dictionary.to_numpy(zero_copy_only=False).astype(object)
    hashed = pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, np.uint64)
    return rows, (mix(hashed)[codes.indices.to_numpy()] if len(known) else hashed), flat


def window_minimum(key: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours, by doubling."""
    have = 1
    while 2 * have <= size:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    return np.minimum(key[:len(key) - (size - have)], key[size - have:]) if size > have else key


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words of each range, wherever it stands."""
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), b, np.uint64)])) for b in (BASE, INVERSE))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] ^ (end - start).astype(np.uint64))


def segments(rows: np.ndarray, h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of the texts in order: row, first window, number of windows, and the hashes of the anchor and of all words."""
    n = len(h) - window + 1
    starts = np.flatnonzero(rows[window - 1:] == rows[:n]) if n > 0 else np.zeros(0, np.int64)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return {"row": none, "start": none, "windows": none, "gram": none.astype(np.uint64), "seg": none.astype(np.uint64)}
    key = mix(h[:len(h) - gram + 1])
    for j in range(1, gram):
        key = mix(key ^ h[j:len(h) - gram + 1 + j])
    place = np.arange(len(key), dtype=np.uint64)
    least = window_minimum((key & np.uint64(0xFFFFFFFF00000000)) | place, window - gram + 1)
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    start, count = starts[first], np.diff(np.append(first, len(starts)))
    seg = mix(range_hash(h, start, start + count + window - 1) ^ (anchor[first] - start).astype(np.uint64))
    return {"row": rows[start], "start": start, "windows": count, "gram": key[anchor[first]], "seg": seg}


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


SEGMENT = "doc_id long, print long, start long, windows int, gram long, seg long"


def segment_rows(docs: DataFrame) -> DataFrame:
    """A row per segment of every document with an id."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, h, _ = word_hashes(b.column("text"))
        s = segments(rows, h)
        count = np.bincount(rows, minlength=b.num_rows)
        first = np.cumsum(count) - count
        take = pa.array(s["row"])
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("print").take(take), pa.array((s["start"] - first[s["row"]]).astype(np.int64)),
                                           pa.array(s["windows"].astype(np.int32)), signed(s["gram"]), signed(s["seg"])],
                                          names=["doc_id", "print", "start", "windows", "gram", "seg"])

    return map_texts(docs.where(F.col("doc_id").isNotNull()), run, SEGMENT, ("doc_id", "print", "text"))


# ---- joins with hot keys

def hot_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join with a table whose ``weight`` says how many of the ``total`` rows have the key: at most HOT_PART keys are hot."""
    hot = F.col(weight) * HOT_PART >= F.lit(total)
    often = table.where(hot)
    known = F.broadcast(often.select(*on).distinct())
    return (rows.join(F.broadcast(often), on)
            .unionByName(rows.join(known, on, "left_anti").join(table.where(~hot), on)))


# ---- trees

def suffix_tree(word: np.ndarray, end: np.ndarray, leaves: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix tree of some places of a word sequence, down to ``depth`` words or a little more.

    ``end`` is, for each place, where its segment ends.  The tree is given by its leaves in order and by the depth, in words, of
    the node at which each leaf parts from the one before it.  Order comes from ranks of doubled length.
    """
    rank, have, levels = np.unique(word, return_inverse=True)[1].astype(np.int64), 1, []
    place = np.arange(len(word))
    while True:
        levels.append((have, rank))
        if 2 * have > depth:
            break
        further = place + have
        second = np.where(further < end, rank[np.minimum(further, len(word) - 1)] + 1, 0)
        rank = np.unique(rank * (len(word) + 2) + second, return_inverse=True)[1]
        have *= 2
    further = leaves + have
    second = np.where(further < end[leaves], rank[np.minimum(further, len(word) - 1)] + 1, 0)
    leaves = leaves[np.argsort(rank[leaves] * (len(word) + 2) + second, kind="stable")]
    a, b, parts = leaves[1:].copy(), leaves[:-1].copy(), np.zeros(len(leaves), np.int64)
    a_end, b_end = end[a], end[b]
    for size, rank in [levels[-1], *reversed(levels)]:
        same = (a + size <= a_end) & (b + size <= b_end)
        same[same] = rank[a[same]] == rank[b[same]]
        a[same] += size
        b[same] += size
        parts[1:][same] += size
    return leaves, parts


def first_below(parts: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """For each leaf the least value below its topmost node of at least ``depth``."""
    if not len(parts):
        return value
    top = parts < depth
    top[0] = True
    start = np.flatnonzero(top)
    return np.repeat(np.minimum.reduceat(value, start), np.diff(np.append(start, len(parts))))


VERDICT = "gram long, seg long, n long, start int, windows int, first long"


def group_verdicts(table: pa.Table) -> pa.Table:
    """Runs of windows with the same first document, for every class of one group; runs without an earlier document of another class go if the class is one row."""
    raw = table.column("words").combine_chunks()
    size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    word = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
    last = np.cumsum(size)
    end = np.repeat(last, size)
    count = size - WINDOW + 1
    of = np.repeat(np.arange(len(size)), count)
    within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    leaves = (last - size)[of] + within
    own = table.column("first").to_numpy().astype(np.int64)
    ordered, parts = suffix_tree(word, end, leaves, WINDOW)
    owner = np.full(len(word), -1, np.int64)
    owner[leaves] = own[of]
    first = np.empty(len(word), np.int64)
    first[ordered] = first_below(parts, owner[ordered], WINDOW)
    value = first[leaves]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    runs, seg = np.diff(np.append(at, len(of))), of[at]
    n = table.column("n").to_numpy()
    some = (n[seg] > 1) | (value[at] < own[seg])
    at, runs, seg = at[some], runs[some], seg[some]
    take = pa.array(seg)
    return pa.table({"gram": table.column("gram").take(take), "seg": table.column("seg").take(take), "n": table.column("n").take(take),
                     "start": pa.array((within[at] + table.column("start").to_numpy()[seg]).astype(np.int32)),
                     "windows": pa.array(runs.astype(np.int32)), "first": pa.array(value[at])})


CONTENT = "gram long, seg long, n long, heavy boolean, first long, start int, words binary"


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of each wanted class (gram, seg, n, heavy, first), taken from its first document."""
    lists = wanted.groupBy(F.col("first").alias("doc_id")).agg(F.collect_list(F.struct("gram", "seg", "n", "heavy")).alias("wanted"))
    lists = materialise(lists, "wanted")
    found = docs.where(F.col("doc_id").isNotNull())
    if lists.count() <= BROADCAST_IDS:
        found = found.join(F.broadcast(lists.select("doc_id")), "doc_id", "left_semi")
    found = found.join(lists, "doc_id").select("doc_id", "text", "wanted")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, h, _ = word_hashes(b.column("text"))
        s = segments(rows, h)
        lists = b.column("wanted")
        flat = pc.list_flatten(lists)
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.uint64)
        gram, seg = (flat.field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("gram", "seg"))
        key = mix(gram ^ mix(seg ^ mix(row)))
        own = mix(s["gram"] ^ mix(s["seg"] ^ mix(s["row"].astype(np.uint64))))
        order = np.argsort(key)
        at = np.minimum(np.searchsorted(key[order], own), max(len(key) - 1, 0))
        hit = np.flatnonzero(key[order][at] == own) if len(key) else np.zeros(0, np.int64)
        hit = hit[np.unique(own[hit], return_index=True)[1]]          # a class once, however often the document has it
        take = pa.array(order[at[hit]]) if len(hit) else pa.array([], pa.int64())
        raw = [h[a:a + c + WINDOW - 1].tobytes() for a, c in zip(s["start"][hit].tolist(), s["windows"][hit].tolist())]
        return pa.RecordBatch.from_arrays([*(flat.field(c).take(take) for c in ("gram", "seg", "n", "heavy")),
                                           b.column("doc_id").take(pa.array(s["row"][hit])), pa.array(np.zeros(len(hit), np.int32)), pa.array(raw, pa.binary())],
                                          names=["gram", "seg", "n", "heavy", "first", "start", "words"])

    return map_texts(found, run, CONTENT, ("doc_id", "text", "wanted"))


def window_rows(content: DataFrame) -> DataFrame:
    """Every window of the classes by itself, with hashes of its prefixes of each length and of all its words."""
    names = [f"p{k}" for k in (*LENGTHS, WINDOW)]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                raw = s.column("words")
                size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) // 8
                word = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
                count = size - WINDOW + 1
                of = np.repeat(np.arange(len(size)), count)
                within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = (np.cumsum(size) - size)[of] + within
                take = pa.array(of)
                gram = s.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)[of]
                data = word.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [s.column(c).take(take) for c in ("gram", "seg", "n", "first")]
                    + [pa.array(within.astype(np.int32)), pa.array([data[8 * a:8 * (a + WINDOW)] for a in start.tolist()], pa.binary())]
                    + [signed(mix(gram ^ range_hash(word, start, start + k))) for k in (*LENGTHS, WINDOW)],
                    names=["gram", "seg", "n", "first", "start", "words", *names])

    return content.mapInArrow(run, "gram long, seg long, n long, first long, start int, words binary, " + ", ".join(f"{c} long" for c in names))


def tree_verdicts(content: DataFrame, key: str, n_words: int) -> DataFrame:
    """Deal suffixes with their prefixes' hashes to groups, and build a tree of each."""
    groups = max(1, -(-n_words // GROUP_WORDS))
    dealt = content.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)))
    return dealt.select("_group", "gram", "seg", "n", "first", "start", "words").groupBy("_group").applyInArrow(group_verdicts, VERDICT)


def verdicts(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """Runs of windows (gram, seg, n, start, windows, first): ``first`` is the smallest id among the documents with these windows."""
    classes = materialise(segs.groupBy("gram", "seg").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows")), "classes")
    grams = materialise(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("all")).where("classes > 1"), "anchors")
    shared = hot_join(classes, grams.select("gram", "classes"), ["gram"], "classes", max(classes.count(), 1))
    shared = materialise(shared.withColumn("heavy", F.col("classes") > GROUP_CLASSES), "shared")
    single = classes.where("n > 1").join(grams.select("gram"), "gram", "left_anti")
    out = single.select("gram", "seg", "n", F.lit(0).alias("start"), "windows", "first")
    content = materialise(contents(docs, shared), "contents")
    sizes = {r["heavy"]: r["w"] for r in shared.groupBy("heavy").agg(F.sum(F.col("windows") + WINDOW - 1).alias("w")).collect()}
    if False in sizes:
        out = out.unionByName(tree_verdicts(content.where(~F.col("heavy")), "gram", sizes[False]))
    if True in sizes:
        left = materialise(window_rows(content.where("heavy")), "windows")
        for k in LENGTHS:
            prefix = f"p{k}"
            counts = left.groupBy(prefix).agg(F.count(F.lit(1)).alias("suffixes"))
            many = GROUP_WORDS // WINDOW
            left = materialise(hot_join(left, materialise(counts, "prefixes"), [prefix], "suffixes", max(left.count(), 1)), "windows")
            light = left.where(F.col("suffixes") <= many)
            out = out.unionByName(tree_verdicts(light, prefix, WINDOW * light.count()))
            left = left.where(F.col("suffixes") > many).drop("suffixes")
        whole = f"p{WINDOW}"
        nodes = left.groupBy(whole).agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("leaves"))
        left = hot_join(left, materialise(nodes, "nodes"), [whole], "leaves", max(left.count(), 1))
        out = out.unionByName(left.select("gram", "seg", "n", "start", F.lit(1).alias("windows"), F.col("least").alias("first")))
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans (doc_id, print, start, words, first) of repeated words: ``first`` is the smallest id of a document with these windows.

    ``print`` tells rows of one id apart by their text, see ``with_print``.  Spans of neighbouring segments may overlap.
    """
    segs = materialise(segment_rows(docs), "segments")
    found = materialise(verdicts(docs, segs), "verdicts")
    hits = hot_join(segs.select("doc_id", "print", F.col("start").alias("at"), "gram", "seg"), found, ["gram", "seg"], "n", max(segs.count(), 1))
    return hits.where("first < doc_id").select("doc_id", "print", (F.col("at") + F.col("start")).alias("start"), (F.col("windows") + WINDOW - 1).alias("words"), "first")


def with_print(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), "text")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Each row's words, those removed, and the text left (words joined by one blank; null without ``keep_text``)."""
    docs = with_print(docs)
    spans = repeated_spans(docs).groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "words")).alias("spans"))
    none = F.lit(None).cast("array<struct<start:bigint,words:int>>").alias("spans")
    spans = spans.select("doc_id", "print", F.col("spans").cast("array<struct<start:bigint,words:int>>").alias("spans"))
    joined = docs.where(F.col("doc_id").isNotNull()).join(spans, ["doc_id", "print"], "left").select("doc_id", "text", "spans")
    joined = joined.unionByName(docs.where(F.col("doc_id").isNull()).select("doc_id", "text", none))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        rows, flat = words(pc.fill_null(b.column("text"), ""))
        count = np.bincount(rows, minlength=n)
        first = np.cumsum(count) - count
        lists = b.column("spans")
        span, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        start = span.field("start").to_numpy(zero_copy_only=False).astype(np.int64) + first[row]
        edge = np.zeros(len(rows) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + span.field("words").to_numpy(zero_copy_only=False), -1)
        stays = np.cumsum(edge[:-1]) == 0
        kept = np.bincount(rows[stays], minlength=n)
        offsets = np.zeros(n + 1, np.int32)
        np.cumsum(kept, out=offsets[1:])
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(stays))), " ")
        sha = [hashlib.sha256(t.as_buffer()).hexdigest() for t in text]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count.astype(np.int64)), pa.array((count - kept).astype(np.int64)), pa.array(sha, pa.string()),
                                           text if keep_text else pa.nulls(n, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return map_texts(joined, run, RESULT, ("doc_id", "text", "spans"))


def op12_substring_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove words of repeated 50-word windows from all documents."""
    return remove_repeats(documents(spark, sf_dir), keep_text=False).drop("kept")


QUERIES = {"op12_substring_trees": op12_substring_trees}

ORACLE_SQL = {"op12_substring_trees": r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM texts)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM windows JOIN firsts USING (k), range(0, 50) r(o) WHERE doc_id > first),
every AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts),
left_over AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept
  FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN left_over USING (doc_id)
"""}
