"""Toxicity by multiple-instance learning: a document is a bag of sentences, toxic if any of them is.

A sentence scores sigmoid(bias + sum of the weights of its words and word beginnings); a document scores by noisy-or over its sentences,
1 - prod(1 - p).  The weights are learnt from document labels alone by proximal gradient steps on the noisy-or
likelihood (L1 keeps them sparse), and the trained sentence scores then locate the offending sentences.

Sentences end at a word that ends in ``. ! ?`` or after ``LONGEST`` words.  Fitting sees at most about ``SAMPLE``
labelled documents, chosen by a hash of the id, read whole.  Null and empty texts have no sentence and score 0;
without labels of both classes every document scores 0 (no evidence rejects nothing).  Repeated rows keep their
rows, extra columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compovec.llm.common import documents, is_held_out, labelled, map_texts, sample_by_hash, slices, words

#: Bound of the labelled documents that the fit sees.
SAMPLE = 4_000
LONGEST = 60
MIN_DOCUMENTS = 4
LIFT = 3.0
#: Lengths of the word beginnings that are features beside the whole word, for inflected forms.
PREFIXES = (4, 5, 6, 7)
REJECT = 0.7


@dataclass
class Sentences:
    rows: np.ndarray         # document of each sentence
    first: np.ndarray        # its first word, counted in the document
    length: np.ndarray
    word_at: np.ndarray      # sentence of each word
    code: np.ndarray         # distinct word of each word
    keys: np.ndarray         # distinct words x features: hashes of the whole word and of its beginnings


def features(vocabulary: pa.Array) -> np.ndarray:
    """Hashes of each word in lower case without punctuation at its ends, and of its beginnings (0 where as long as the word)."""
    bare = pc.utf8_lower(pc.replace_substring_regex(vocabulary, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    out = np.zeros((len(bare), 1 + len(PREFIXES)), np.uint64)
    if not len(bare):
        return out
    length = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    for j, k in enumerate((0, *PREFIXES)):
        part = pc.utf8_slice_codeunits(bare, 0, k) if k else bare
        hashed = pd.util.hash_array(part.to_numpy(zero_copy_only=False).astype(object), categorize=False)
        out[:, j] = np.where(length > k, hashed ^ np.uint64(k), 0)
    return out


def sentences(texts: pa.Array) -> Sentences:
    rows, flat = words(texts)
    codes = flat.dictionary_encode()
    index, vocabulary = codes.indices.to_numpy(), codes.dictionary
    n, none = len(rows), np.zeros(0, np.int64)
    if not n:
        return Sentences(none, none, none, none, none, features(vocabulary))
    ends = pc.match_substring_regex(vocabulary, r"""[.!?]["')\]]*$""").to_numpy(zero_copy_only=False)
    new_doc = np.empty(n, bool)
    new_doc[0], new_doc[1:] = True, rows[1:] != rows[:-1]
    start = new_doc.copy()
    start[1:] |= ends[index[:-1]]
    begin = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    start |= (np.arange(n) - begin) % LONGEST == 0
    at = np.flatnonzero(start)
    doc_begin = np.maximum.accumulate(np.where(new_doc, np.arange(n), 0))
    return Sentences(rows[at], at - doc_begin[at], np.diff(np.append(at, n)), np.cumsum(start) - 1, index, features(vocabulary))


@dataclass
class Model:
    keys: np.ndarray         # sorted feature hashes
    weights: np.ndarray
    bias: float

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(s.rows), 1 / (1 + np.exp(-self.bias)))
        at = np.minimum(np.searchsorted(self.keys, s.keys), len(self.keys) - 1)
        w = np.where(self.keys[at] == s.keys, self.weights[at], 0.0).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(np.bincount(s.word_at, w[s.code], len(s.rows)) + self.bias, -40, 40)))


NO_EVIDENCE = Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)


def noisy_or(p: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(rows, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def fit(texts: pa.Array, y: np.ndarray, steps: int = 400, rate: float = 0.5, l1: float = 5e-5) -> Model:
    if not len(y) or y.min() == y.max():
        return NO_EVIDENCE
    s = sentences(texts)
    n = len(y)
    keys, at = np.unique(s.keys, return_inverse=True)
    at = at.reshape(s.keys.shape)
    seen, toxic = np.zeros(len(keys), np.int64), np.zeros(len(keys))
    row = s.rows[s.word_at]
    for first in range(0, n, 250):                          # a few documents at a time: the pairs are many
        own = slice(*np.searchsorted(row, (first, first + 250)))
        doc, word = np.divmod(np.unique((row[own] - first) * len(s.keys) + s.code[own]), len(s.keys))
        pairs = np.unique(doc[:, None] * len(keys) + at[word])
        seen += np.bincount(pairs % len(keys), minlength=len(keys))
        toxic += np.bincount(pairs % len(keys), y[first + pairs // len(keys)], len(keys))
    # in a noisy-or only evidence for toxicity needs a weight: features of few documents or without a lift are left out
    keys = keys[(seen >= MIN_DOCUMENTS) & (toxic / seen >= LIFT * y.mean()) & (keys > 0)]
    m = len(keys)
    if not m:
        return NO_EVIDENCE
    found = np.minimum(np.searchsorted(keys, s.keys), m - 1)
    live = keys[found] == s.keys
    hit = np.flatnonzero(live.any(axis=1)[s.code])
    some = live[s.code[hit]]
    sent, word = np.repeat(s.word_at[hit], some.sum(axis=1)), found[s.code[hit]][some]
    w, b, gw, gb = np.zeros(m), -5.0, np.full(m, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sent, w[word], len(s.rows)) + b, -30, 30)))
        bag = np.clip(noisy_or(p, s.rows, n), 1e-9, 1 - 1e-9)
        # d log-likelihood / d sentence logit: p (1 - P) / P in a toxic document, -p in a clean one
        pull = np.where(y[s.rows] > 0, p * ((1 - bag) / bag)[s.rows], -p) / n
        grad, gradb = np.bincount(word, pull[sent], m), pull.sum()
        gw, gb = gw + grad * grad, gb + gradb * gradb
        step = rate / np.sqrt(gw)
        w = w + step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b += rate / np.sqrt(gb) * gradb
    keep = np.abs(w) > 1e-3
    return Model(keys[keep], w[keep], float(b))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Whole texts of a bounded sample of labelled documents; its ids are few enough to broadcast."""
    chosen = sample_by_hash(labels, "doc_id", SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").toPandas()
    rows = rows.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    return fit(pa.array(rows["text"], pa.large_string()), rows["label"].to_numpy(float))


SCORED = "doc_id long, score double, n_sentences long, spans array<struct<start:int,stop:int,score:double>>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def locate(text: str, first: np.ndarray, length: np.ndarray, p: np.ndarray) -> list[dict]:
    """Character spans of sentences, from their word positions."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return [{"start": spans[a][0], "stop": spans[a + k - 1][1], "score": float(q)} for a, k, q in zip(first, length, p)]


def scorer(model: Model):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(b.column("text"), "")
        n = len(texts)
        s = sentences(texts)
        p = model.sentence_scores(s)
        spans: list[list[dict]] = [[] for _ in range(n)]
        bad = np.flatnonzero(p >= 0.5)
        cut = np.searchsorted(s.rows[bad], np.unique(s.rows[bad]), side="left") if len(bad) else []
        for own in np.split(bad, cut[1:]) if len(bad) else []:
            row = int(s.rows[own[0]])
            spans[row] = locate(texts[row].as_py(), s.first[own], s.length[own], p[own])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(noisy_or(p, s.rows, n)), pa.array(np.bincount(s.rows, minlength=n)),
                                           pa.array(spans, kind)], names=["doc_id", "score", "n_sentences", "spans"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score of each document, and the spans of its offending sentences."""
    return map_texts(docs, scorer(model), SCORED)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``REJECT``."""
    def run(batches):
        for b in slices(batches):
            s = sentences(b.column("text"))
            yield b.filter(pa.array(noisy_or(model.sentence_scores(s), s.rows, b.num_rows) < REJECT))

    return docs.mapInArrow(run, docs.schema)


def op3_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt outside the held-out fold."""
    docs = documents(spark, sf_dir)
    model = train(spark, docs, labelled(spark, sf_dir, "toxic", 3, 1))
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["start"], F.lit(":"), x["stop"])), ",")
    return score(docs, model).select("doc_id", is_held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                                     F.when(F.col("score") >= REJECT, 1).otherwise(0).alias("predicted"), "n_sentences", spans.alias("offending"))


QUERIES = {"op3_mil_toxicity": op3_mil_toxicity}
