"""Secret scan: fixed patterns, plus values in a credential context that are costly to guess.

The guess cost of a value is the least total of log2 guesses over all segmentations into dictionary words,
dates, repeats, alphabet and digit sequences, keyboard walks and brute-force spans, found by dynamic
programming over its positions; a value of ``THRESHOLD`` bits or more is reported as kind ``guess``.

Null text counts as empty (no spans).  Repeated rows keep their own results; spans that start together are
ordered by kind as listed; extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from compovec.llm.common import documents, map_texts, slices

# The kinds in order, and the base patterns.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")          # AKIA[A-Z0-9]+ of 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")                 # [0-9a-f]+ of 24 characters or more

#: Words that announce a credential, and the value after them.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|login|signature|client_?id|session_?id
    |(?:api|access|private|secret|encryption|signing|account)[_\x20-]?key)["'\]]?(?:\x20*(?:=>|:=|[:=])\x20*|\x20+is\x20+|\x20+bearer\x20+)(?:bearer\x20+|basic\x20+)?["'`]?([^\s"'`,;<>(){}]+)""", re.I | re.A | re.X)
VALUE = r"(?i)(?:pass|pwd|pin|secret|token|credential|auth|bearer|login|signature|client_?id|session_?id|key)[a-z]*[\"'\]]?(?: *(?:=>|:=|[:=])| +is +| +bearer +)"

THRESHOLD = 40.0
SHORTEST = 8

# Words that people use in passwords and as placeholders, most used first; own choice.
WORDS = """password pass 123456 qwerty admin welcome letmein changeme secret default guest root test user login master dragon monkey football baseball iloveyou
sunshine princess shadow summer winter spring autumn monday friday january august october hello world love money computer internet service server
example sample demo your my the key token value here enter insert replace placeholder dummy fake none null true false string text name account access
public private client database config system company office home family freedom michael jordan charlie daniel thomas george hunter ranger killer
soccer hockey tiger eagle falcon phoenix orange purple yellow silver golden diamond cookie pepper ginger coffee chocolate banana flower butterfly
london paris berlin madrid america england france german spanish english first last new old big good best super cool happy lucky strong""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@31!0$57", "aaeiiosst")


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch on a slanted keyboard."""
    at = {c: (r, i) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}
    return {c: {d for d, (q, j) in at.items() if d != c and abs(q - r) <= 1 and abs(j - i) <= 1 and (q != r or abs(i - j) == 1)} for c, (r, i) in at.items()}


NEIGHBOURS = _neighbours()
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d"
                  r"|(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")


def alphabet(value: str) -> float:
    """log2 of the characters that brute force must try at each place of this value."""
    kinds = ((r"[0-9]", 10), (r"[a-z]", 26), (r"[A-Z]", 26), (r"[^0-9A-Za-z]", 33))
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 4.0
    return math.log2(sum(n for p, n in kinds if re.search(p, value)) or 1)


def runs(value: str) -> list[tuple[np.ndarray, str]]:
    """For each place the end of the longest repeat, sequence and keyboard walk that starts there."""
    low, n, out = value.lower(), len(value), []
    tests = (("repeat", lambda a, b: a == b), ("up", lambda a, b: ord(b) - ord(a) == 1 and a.isalnum() and b.isalnum()),
             ("down", lambda a, b: ord(a) - ord(b) == 1 and a.isalnum() and b.isalnum()), ("walk", lambda a, b: b in NEIGHBOURS.get(a, ())))
    for kind, joined in tests:
        end = np.arange(1, n + 1)
        for i in range(n - 2, -1, -1):
            if joined(low[i], low[i + 1]):
                end[i] = end[i + 1]
        out.append((end, kind))
    return out


def segments(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    """Least cost in bits, and the segmentation that has it.  Linear in the value's length."""
    n = len(value)
    low, brute = value.lower(), alphabet(value)
    leet = low.translate(LEET)
    ends = runs(value)
    cost, back = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)

    def offer(i: int, j: int, bits: float, kind: str) -> None:
        if cost[i] + bits < cost[j]:
            cost[j], back[j] = cost[i] + bits, (i, kind)

    for i in range(n):
        offer(i, i + 1, brute, "brute")
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            piece = value[i:j]
            rank = RANK.get(low[i:j])
            if rank:
                case = 0 if piece == low[i:j] else 1 if piece[1:] == low[i + 1:j] or piece.isupper() else j - i
                offer(i, j, 1 + math.log2(rank) + case, "word")
            elif rank := RANK.get(leet[i:j]):
                offer(i, j, 3 + math.log2(rank) + (piece != low[i:j]), "word")
        if value[i].isdigit() and (m := DATE.match(value, i)):
            offer(i, m.end(), math.log2(365 * 120) if m.end() - i > 4 else math.log2(120), "date")
        for end, kind in ends:
            j = int(end[i])
            if j - i >= 3:
                base = brute if kind == "repeat" else math.log2(48) + (j - i) / 4 if kind == "walk" else 4.0
                offer(i, j, base + math.log2(j - i), kind)
    out, j = [], n
    while j:
        i, kind = back[j]
        if out and kind == "brute" == out[-1][2]:
            out[-1] = (i, out[-1][1], kind)
        else:
            out.append((i, j, kind))
        j = i
    return cost[n], out[::-1]


@lru_cache(maxsize=50_000)
def guess_bits(value: str) -> float:
    return segments(value)[0]


def spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of every secret, by start and then kind."""
    out = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        value = m.group(1).rstrip(".:!?")
        if len(value) >= SHORTEST and (guess_bits(value) if len(value) < 200 else segments(value)[0]) >= THRESHOLD:
            out.append((m.start(1), 3, m.start(1) + len(value), m.start(1), m.start(1) + len(value)))
    return sorted(out)


def candidates(texts: pa.Array) -> np.ndarray:
    """Rows that can hold a span at all, by linear-time patterns on whole texts."""
    some = pc.or_(pc.match_substring(texts, "AKIA"), pc.match_substring_regex(texts, "[0-9a-f]{24}"))
    keyed = pc.match_substring_regex(texts, VALUE)
    return pc.or_(some, keyed).to_numpy(zero_copy_only=False)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def joined(found: list[tuple[int, int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _, _ in found)


def scan_batch(b: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(b.column("text"), "")
    n = len(texts)
    counts = np.zeros((4, n), np.int64)
    empty = hashlib.sha256(b"").hexdigest()
    digest, text = [empty] * n, [""] * n
    for i in np.flatnonzero(candidates(texts)):
        found = spans(texts[int(i)].as_py())
        for s in found:
            counts[s[1], i] += 1
        digest[i] = hashlib.sha256(joined([s for s in found if s[1] < 3]).encode()).hexdigest()
        text[i] = joined(found)
    return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *map(pa.array, counts[:3]), pa.array(digest, pa.string()),
                                       pa.array(text, pa.string()), pa.array(counts[3])],
                                      names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])


def scan(docs: DataFrame) -> DataFrame:
    """Counts and spans of secrets per row; a map without a shuffle."""
    return map_texts(docs, scan_batch, SCHEMA)


def redacted(text: str, mark: str = "[REDACTED]") -> str:
    """The text with every secret value replaced; overlapping values become one mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted((s[3], s[4]) for s in spans(text)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with secret values replaced in ``text``; a changed row's ``n_chars``, if there is one, follows."""
    schema = docs.schema

    def run(batches):
        for b in slices(batches):
            at = np.flatnonzero(candidates(pc.fill_null(b.column("text"), "")))
            if len(at):
                texts = b.column("text").to_pylist()
                counted = b.column("n_chars").to_pylist() if "n_chars" in b.schema.names else None
                for i in at:
                    new = redacted(texts[i])
                    if counted is not None and new != texts[i]:
                        counted[i] = len(new)
                    texts[i] = new
                columns = {"text": texts} | ({"n_chars": counted} if counted is not None else {})
                b = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else b.column(f.name) for f in b.schema], schema=b.schema)
            yield b

    return docs.mapInArrow(run, schema)


def op5_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan(documents(spark, sf_dir))


QUERIES = {"op5_guess_cost": op5_guess_cost}
