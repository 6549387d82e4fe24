"""Packing token sequences by minimum bin slack.

Documents are cut into full windows and one remainder each.  What has to be packed is then only the number of
remainders of each length, at most ``WINDOW`` - 1 numbers however large the corpus: the plan is made on them.  A
bitset dynamic program over sums (bit s is set if some multiset of remaining lengths adds up to s) finds the filling
closest to the window that holds the longest remainder left; its counts are traced back and the filling is
repeated as often as the counts allow.  Pieces learn their place from an exact rank among equal lengths.

Null text counts as empty: one piece, the end mark.  Repeated rows are packed once each, ties go by id and
content; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compovec.llm.common import documents, gapless, map_texts, materialise, words

WINDOW = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"


#: Words that split without a choice: one run of letters (ASCII and Latin-1) between runs of ASCII punctuation.  An apostrophe before
#: the letters could begin a contraction, so such words take the long way.
SIMPLE = r"^(?P<before>[!-&(-/:-@\[-`{-~]*)(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<after>[!-/:-@\[-`{-~]*)$"


class Words:
    """Ids of words, as little-endian 32-bit integers.

    The tokenizer drops white space and never joins across it, so words can be encoded apart.  Most words are new, but their
    letters are not: simple words are lower-cased and split by columns, and each distinct part is encoded once per batch by the
    tokenizer's model alone.  All other words go through the whole tokenizer.  Nothing is kept from batch to batch.
    """

    def __init__(self, name: str) -> None:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.parts = Tokenizer(self.whole.model)                      # the same model, for parts that are normal and split already
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole.encode_special_tokens = True

    @staticmethod
    def learn(tokenizer, new: pa.Array, step: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        flat, size = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(new), step):
            some = new.slice(i, step).to_numpy(zero_copy_only=False).tolist()
            got = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(got.ids, "<u4"))
            size.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(flat), np.concatenate(size)

    def many(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has."""
        split = pc.extract_regex(words, SIMPLE)
        simple = split.is_valid()
        split, easy = split.filter(simple), simple.to_numpy(zero_copy_only=False)
        pool, sizes, index, n = [], [], np.zeros((len(split), 3), np.int64), 0
        for k, part in enumerate((split.field("before"), pc.utf8_lower(split.field("letters")), split.field("after"))):
            codes = part.dictionary_encode()
            flat, size = self.learn(self.parts, codes.dictionary)         # the empty string has no ids
            pool.append(flat)
            sizes.append(size)
            index[:, k] = codes.indices.to_numpy() + n
            n += len(size)
        flat, size = self.learn(self.whole, words.filter(pc.invert(simple)))
        pool.append(flat)
        sizes.append(size)
        place = np.zeros((len(words), 3), np.int64)
        place[easy] = index
        part_size = np.concatenate([*sizes, [0]])                        # the last one is an empty part
        place[~easy, 0] = n + np.arange(len(size))
        place[~easy, 1:] = n + len(size)
        ids, _ = gather(np.concatenate(pool), part_size, place.ravel())
        return ids, part_size[place].sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 offsets; a word is looked up once per batch."""
        rows, flat = words(texts)
        codes = flat.dictionary_encode()
        known, size = self.many(codes.dictionary)
        ids, own = gather(known, size, codes.indices.to_numpy())
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(rows, own, len(texts)).astype(np.int64), out=offsets[1:])
        return ids, offsets


def gather(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` (``size`` long each) in the order of ``index``, end to end, and their sizes."""
    if not len(index):
        return flat[:0], np.zeros(0, np.int64)
    own = size[index]
    start = (np.cumsum(size) - size)[index]
    return flat[np.repeat(start - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))], own


@lru_cache(maxsize=2)
def encoder(name: str) -> Words:
    return Words(name)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """Tokenize whole texts, add the end mark, and cut at multiples of the window."""
    end = np.array([END], "<u4").tobytes()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, off = encoder(tokenizer).encode(pc.fill_null(b.column("text"), ""))
        data, rows = ids.tobytes(), []
        for doc, a, e in zip(b.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
            raw, n = data[4 * a:4 * e] + end, e - a + 1
            rows += [(doc, at, min(window, n - at), zlib.crc32(raw[4 * at:4 * (at + window)]), n) for at in range(0, n, window)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=names)

    return map_texts(docs, run, PIECE)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (within ``counts``) whose sum is the largest at most ``room``."""
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        stages.append((length, reach))
        left, take = min(counts[length], room // length), 1
        while left > 0:                                   # bounded copies by doubling
            take = min(take, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, last rank, first bin, per bin, offset) that place every remainder, and the number of bins."""
    left, used = {k: v for k, v in counts.items() if v > 0}, dict.fromkeys(counts, 0)
    rows, bins = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        chosen = fullest(rest, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for k, n in sorted(chosen.items(), reverse=True):
            rows.append((k, used[k], used[k] + n * times - 1, bins, n, offset))
            used[k] += n * times
            left[k] -= n * times
            if not left[k]:
                del left[k]
            offset += n * k
        bins += times
    return rows, bins


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """Every piece with its sequence and offset."""
    pieces = materialise(cut_pieces(docs, tokenizer, window), "pieces")
    part = pieces.where(F.col("length") < window)
    counts = {r["length"]: r["count"] for r in part.groupBy("length").count().collect()}      # fewer rows than the window
    rows, bins = plan(counts, window)
    placing = docs.sparkSession.createDataFrame(rows, "p_length long, first long, last long, bin long, per long, base long")
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    names = [f.split()[0] for f in PIECE.split(", ")]
    ranked = gapless(part, ["length"], order)
    # the plan grows with the window's lengths and not with the corpus
    placed = ranked.join(F.broadcast(placing), (F.col("length") == F.col("p_length")) & F.col("slot").between(F.col("first"), F.col("last")))
    at = F.col("slot") - F.col("first")
    placed = placed.select(*names, (F.col("bin") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
                           (F.col("base") + (at % F.col("per")) * F.col("length")).cast("long").alias("offset"))
    full = gapless(pieces.where(F.col("length") == window).withColumn("_all", F.lit(0)), ["_all"], order)
    full = full.select(*names, (F.col("slot") + bins).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def op2_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(documents(spark, sf_dir))


QUERIES = {"op2_slack_packing": op2_slack_packing}
