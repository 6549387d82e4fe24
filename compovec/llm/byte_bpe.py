"""Byte-level BPE encoding and decoding by longest matches with backtracking.

A tokenization is the one that merges would give exactly when each two neighbouring tokens, encoded together by
merges, stay as they are.  So the encoder walks left to right with the longest token at each place (found in an
Aho-Corasick automaton over bytes written as Latin-1), falls back to the next shorter token, and steps back where
none fits; places found dead are never entered again and pair tests are memoised, so the work is linear in the
length.  Every match of the pattern is encoded on its own, and equal matches are encoded once per worker.

Null text counts as empty: no ids, digests of the empty string.  Repeated rows keep their own results; extra
columns are ignored.  The rank file is a parameter and is read on the executors from the installed package.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from compovec.llm.common import documents, map_texts, spread_codes

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Entries of a worker's memos before the older half is let go.
MEMO = 400_000


class Memo(dict):
    """A dictionary of bounded size in two generations: what was not asked for lately goes first."""

    def __init__(self, bound: int = MEMO) -> None:
        super().__init__()
        self.bound, self.old = bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def compute(self, key):
        raise KeyError(key)


class Pairs(Memo):
    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__(MEMO)
        self.bpe = bpe

    def compute(self, key):
        """Whether no merge crosses the border: walk down both sides of it, from the latest merge to the earliest.

        Just before a token was merged its inner half stood at the border; a pair across the border would have been
        merged instead if its rank is lower (or equal, when the right side's merge is the rival: the left pair goes first).
        """
        left, right = key
        tokens, ranks, halves, limit = self.bpe.tokens, self.bpe.ranks, self.bpe.halves, 1 << 60
        while True:
            if ranks.get(tokens[left] + tokens[right], limit) < limit:
                return False
            if left > right:
                split = halves[left]
                if split is None:
                    return True
                limit, left = left, split[1]
            else:
                split = halves[right]
                if split is None:
                    return True
                limit, right = right + 1, split[0]


class Pieces(Memo):
    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__()
        self.bpe = bpe

    def compute(self, key):
        return array("I", self.bpe.encode(key.encode("utf-8", "surrogatepass"))).tobytes()


class Parts(Memo):
    """Ids of text between single blanks."""

    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__()
        self.bpe, self.pattern = bpe, regex.compile(public_tokenizers.PATTERN)

    def compute(self, key):
        return b"".join(map(self.bpe.pieces.__getitem__, self.pattern.findall(key)))


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        automaton = ahocorasick.Automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        usable = [t for t in ranks if self._reachable(t)]        # the others never come out of merges
        for t in usable:
            automaton.add_word(t.decode("latin-1"), (ranks[t], len(t)))
        automaton.make_automaton()
        self.automaton = automaton
        known = set(usable)
        #: the longest usable token that begins a token, or -1
        self.shorter = {ranks[t]: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1) for t in usable}
        self.fits, self.pieces, self.parts = Pairs(self), Pieces(self), Parts(self)
        self.size_of = {i: len(t) for i, t in self.tokens.items()}
        size = max(self.tokens, default=-1) + 1
        self.length = np.zeros(size, np.int64)
        for i, t in self.tokens.items():
            self.length[i] = len(t)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def _reachable(self, token: bytes) -> bool:
        """Whether merging a token's bytes, lowest rank first, gives the token; notes the two halves of its last merge."""
        halves, parts = None, [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            halves = (parts[at], parts[at + 1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 1:
            return False
        own = self.ranks[token]
        self.halves[own] = halves and (self.ranks[halves[0]], self.ranks[halves[1]])
        return halves is None or max(self.halves[own]) < own or len(token) == 2

    def longest(self, data: bytes) -> list[int]:
        """For each place the longest token that starts there."""
        best, size = [-1] * len(data), [0] * len(data)
        for end, (token, n) in self.automaton.iter(data.decode("latin-1")):
            at = end - n + 1
            if n > size[at]:
                best[at], size[at] = token, n
        return best

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None and whole in self.shorter:
            return [whole]
        n, best, length, fits, shorter = len(data), self.longest(data), self.size_of, self.fits, self.shorter
        alive, out, at = bytearray(b"\1" * (n + 1)), [], 0
        token = best[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if alive[end] and (last < 0 or fits[last, token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = best[at] if at < n else -1
            elif out:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
                token = shorter[token]
            else:
                raise ValueError("a byte of the text has no token")
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        total = int(n.sum())
        step = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        return self.flat[step].tobytes()


def load_ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoder(name: str) -> tuple[ByteBPE, regex.Pattern]:
    """One per worker process."""
    return ByteBPE(load_ranks(name)), regex.compile(public_tokenizers.PATTERN)


def token_bytes(text: str, bpe: ByteBPE, pattern: regex.Pattern) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    return b"".join(map(bpe.pieces.__getitem__, pattern.findall(text)))


#: A blank next to other white space: there a text is not cut before it is matched.
_BESIDE = r"[\s\x0b\x1c-\x1f\x85\p{Z}] | [\s\x0b\x1c-\x1f\x85\p{Z}]"


def encode_batch(texts: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the n + 1 offsets.

    No match of the pattern holds a blank that follows another character, unless that is white space too; so texts
    are cut before single blanks, and each distinct part is matched and encoded once per batch.
    """
    bpe, pattern = encoder(name)
    n = len(texts)
    whole = pc.match_substring_regex(texts, _BESIDE)
    lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(n), count)
    codes = pc.list_flatten(lists).dictionary_encode()
    parts = codes.dictionary.to_pylist()
    first = np.zeros(len(rows), bool)
    first[np.cumsum(count)[count > 0] - count[count > 0]] = True
    index = codes.indices.to_numpy().astype(np.int64)
    # a part after a blank, a part at the start of a text, a text that stays whole
    used = np.zeros(len(parts), bool)
    used[index[first]] = True
    memo = bpe.parts
    raw = [memo[" " + p] for p in parts] + [memo[p] if u else b"" for p, u in zip(parts, used)]
    index = np.where(first, index + len(parts), index)
    slow = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    for i in slow:
        at = int(count[:i].sum())                         # its only part, an empty one
        index[at] = len(raw)
        raw.append(token_bytes(texts[int(i)].as_py(), bpe, pattern))
    return spread_codes(raw, index, rows, n)


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and the ids of each text, as an array."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, off = encode_batch(pc.fill_null(b.column("text"), ""), ranks)
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int64)))
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "ids"])

    return map_texts(docs, run, "doc_id long, ids array<long>")


def digests(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Number and digest of the ids of each text, and the digest of what they decode to."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, off = encode_batch(pc.fill_null(b.column("text"), ""), ranks)
        bpe, _ = encoder(ranks)
        ids_sha, text_sha = [], []
        for a, e in zip(off[:-1], off[1:]):
            own = ids[a:e]
            ids_sha.append(hashlib.sha256(own.tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(own)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(np.diff(off)), pa.array(ids_sha, pa.string()),
                                           pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return digests(documents(spark, sf_dir))


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
