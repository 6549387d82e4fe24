"""Statistics of whole documents, computed with NumPy on Arrow slices; one row per input row and no shuffle.

Words are runs of characters other than ASCII white space.  Null text counts as empty: every count is 0 and
every share is 0.  Repeated rows keep their own results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from compovec.llm.common import map_texts, words

#: Counts that queries return, then the shares that models see.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "exclamations", "distinct",
            "most_common", "adjacent", "lines", "non_ascii", "ends")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{f} double" for f in FEATURES)

_CLASS = {"space": b" \t\n\v\f\r", "symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digit": b"0123456789",
          "punct": b".,;:!?'\"()[]{}-_/\\@^~`+=", "bang": b"!", "newline": b"\n", "stop": b".!?"}


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_TABLES = {k: _table(v) for k, v in _CLASS.items()}


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets into them."""
    a = texts.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return data, off - off[0]


def per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def group_sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the size of its group of equal keys, and whether it is the group's first in input order."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    new = np.empty(len(key), bool)
    new[0] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(new)
    size = np.empty(len(key), np.int64)
    size[order] = np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))
    first = np.zeros(len(key), bool)
    first[order[starts]] = True
    return size, first


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and how many of them equal an earlier line."""
    n = len(texts)
    lists = pc.split_pattern(texts, "\n")
    lines = pc.list_flatten(lists)
    rows = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    rows, lines = rows[some.to_numpy(zero_copy_only=False)], lines.filter(some)
    codes = lines.dictionary_encode()
    key = rows.astype(np.int64) * (len(codes.dictionary) + 1) + codes.indices.to_numpy()
    _, first = group_sizes(key)
    return np.bincount(rows, minlength=n), np.bincount(rows[~first], minlength=n)


def word_repeats(rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Per text: words that lie in a 3-word window found at least twice in it."""
    covered = np.zeros(len(rows), bool)
    if len(rows) >= 3:
        at = np.flatnonzero(rows[2:] == rows[:-2])
        c = codes.astype(np.uint64)
        key = mix(rows[at].astype(np.uint64) + np.uint64(1))
        for k in range(3):
            key = mix(key ^ mix(c[at + k] + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(k))
        size, _ = group_sizes(key)
        for k in range(3):
            covered[at[size > 1] + k] = True
    return np.bincount(rows[covered], minlength=n)


def statistics(b: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(b.column("text"), "")
    n = len(texts)
    data, off = raw(texts)
    counts = {k: per_row(t[data], off) for k, t in _TABLES.items()}
    lead = (data & 0xC0) != 0x80
    chars = per_row(lead, off)
    word_chars = per_row(lead & ~_TABLES["space"][data], off)
    non_ascii = per_row(data >= 0xC0, off)
    rows, flat = words(texts)
    codes = flat.dictionary_encode()
    index = codes.indices.to_numpy()
    n_words = np.bincount(rows, minlength=n)
    size, first = group_sizes(rows.astype(np.int64) * (len(codes.dictionary) + 1) + index)
    distinct = np.bincount(rows[first], minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, rows[first], size[first])
    same = np.flatnonzero((rows[1:] == rows[:-1]) & (index[1:] == index[:-1])) if len(rows) > 1 else np.zeros(0, np.int64)
    adjacent = np.bincount(rows[same], minlength=n)
    lines, dup = duplicate_lines(texts)
    repeats = word_repeats(rows, index, n)
    w, c, ln = np.maximum(n_words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    features = {"log_words": np.log1p(n_words), "word_length": word_chars / w, "symbols": counts["symbol"] / w, "dup_lines": dup / ln, "repeats": repeats / w,
                "upper": counts["upper"] / c, "digits": counts["digit"] / c, "punctuation": counts["punct"] / c, "exclamations": counts["bang"] / w,
                "distinct": distinct / w, "most_common": most / w, "adjacent": adjacent / w, "lines": lines / w, "non_ascii": non_ascii / c,
                "ends": counts["stop"] / w}
    whole = {"n_words": n_words, "word_chars": word_chars, "n_symbols": counts["symbol"], "n_dup_lines": dup, "n_repeat_words": repeats}
    return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(whole[k].astype(np.int64)) for k in COUNTS],
                                       *[pa.array(features[k].astype(np.float64)) for k in FEATURES]], names=["doc_id", *COUNTS, *FEATURES])


def document_stats(docs: DataFrame) -> DataFrame:
    return map_texts(docs, statistics, SCHEMA)
