"""Conversation structure repair by depth-first branch and bound.

A conversation is to read ``(s?(ua)+)?`` in role initials.  Each of its rows is kept (free), given the role that fits (1) or
deleted (2, a must for blank and repeated rows); empty turns may be inserted anywhere (5); a truncated row that stays adds 5.
Among the cheapest edits the least audit (the initials of the edits, in ASCII order) is taken.

The search walks rows depth first with an explicit stack.  A node is (rows done, role state).  Suffix lower bounds come from a
backward pass over a relaxed pattern in which a lone system turn is a complete conversation; the incumbent is the best
(cost, audit) so far, and a branch goes when its bound is above the incumbent's cost, or equal to it with a later audit.  Each node
keeps the best prefix that reached it; worse prefixes are dominated.  When the stack is empty the incumbent is proved
optimal.  Audits are paths in a tree of edits, compared back to where they part, so memory is a few numbers per node.

Long conversations are searched in blocks of ``BLOCK`` rows, from every state to every state; the blocks' answers are chained
by the same comparison.  Equal costs up to a common node mean that neither audit begins the other, so a
least audit of a whole consists of least audits of its blocks.  Rows pass through in order, never a conversation's texts at
once: one sorted pass sees codes only and returns the audit in pieces, a second one lets pieces and texts pass side
by side into the digest.  What a task holds are a few bytes per row of its longest conversation.

Null roles and texts are one space; null turns come first; rows of one turn follow in the order of a digest of role and
text.  A null conv_id is a conversation like any other.  Repeated rows are rows, so the later ones are duplicates.  Texts may be
empty or of any length.  An empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compovec.llm.common import bound_batches, materialise

#: Rows that are searched at once.
BLOCK = 1024
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: States in which a conversation may end.
WHOLE = (START, ASSISTANT)
NEVER = 1 << 60
WHITE = " \t\n\x0b\x0c\r"


# ---- one conversation

class Edits:
    """A tree of edits; a node stands for the audit from the root to it."""

    def __init__(self) -> None:
        self.parent, self.piece, self.depth = [-1], [""], [0]

    def add(self, parent: int, piece: str) -> int:
        self.parent.append(parent)
        self.piece.append(piece)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def before(self, a: int, b: int) -> bool:
        """Whether the audit of ``a`` comes before that of ``b`` in ASCII order."""
        parent, piece, depth = self.parent, self.piece, self.depth
        one, two = [], []
        while a != b:
            if depth[a] >= depth[b]:
                one.append(piece[a])
                a = parent[a]
            else:
                two.append(piece[b])
                b = parent[b]
        return "".join(reversed(one)) < "".join(reversed(two))

    def pieces(self, node: int) -> list[str]:
        out = []
        while node > 0:
            out.append(self.piece[node])
            node = self.parent[node]
        return out[::-1]


def step(state: int, initial: str) -> int:
    """The state after a turn with this role initial, or -1."""
    if state == USER:
        return ASSISTANT if initial == "a" else -1
    if initial == "u":
        return USER
    return SYSTEM if initial == "s" and state == START else -1


def follow(state: int) -> int:
    """The state after the user or assistant turn that fits."""
    return ASSISTANT if state == USER else USER


def lower_bounds(rows: list[tuple[str, bool, bool]], goals: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """For each number of rows done a bound of the cost to come at the start, before a user turn, and before an assistant turn.

    The state after a system turn counts as any other before a user turn, which makes the bound a relaxation.
    """
    start = 0 if START in goals else NEVER
    ready = 0 if SYSTEM in goals or ASSISTANT in goals else NEVER
    asked = 0 if USER in goals else NEVER
    out = []
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            initial, must_go, cut = rows[i]
            stay = NEVER if must_go else CUT_OFF if cut else KEEP
            to_ready, to_asked = stay + ready, stay + asked
            start = min(DELETE + start, to_asked + (0 if initial == "u" else REROLE), to_ready if initial == "s" else NEVER)
            ready, asked = (min(DELETE + ready, to_asked + (0 if initial == "u" else REROLE)),
                            min(DELETE + asked, to_ready + (0 if initial == "a" else REROLE)))
        asked = min(asked, INSERT + ready)
        ready = min(ready, INSERT + asked)
        start = min(start, INSERT + asked)
        out.append((start, ready, asked))
    return out[::-1]


#: Place of a state's bound in the triples of ``lower_bounds``.
_BOUND = (0, 1, 2, 1)


def search(rows: list[tuple[str, bool, bool]], entry: int = START, goals: tuple[int, ...] = WHOLE) -> tuple[int, str] | None:
    """Least cost and then least audit that leads ``rows`` (initial, must go, truncated) from ``entry`` to one of ``goals``."""
    n, bound, tree = len(rows), lower_bounds(rows, goals), Edits()
    best: dict[int, tuple[int, int]] = {}                  # node: least cost, and the edits that gave it
    found, leaf = NEVER, -1
    stack = [(bound[0][_BOUND[entry]], 0, entry, 0, 0)]
    while stack:
        least, i, state, cost, path = stack.pop()
        if least >= NEVER or least > found or (least == found and not tree.before(path, leaf)):
            continue
        held = best.get(4 * i + state)
        if held is not None and (cost > held[0] or cost == held[0] and not tree.before(path, held[1])):
            continue
        best[4 * i + state] = cost, path
        if i == n and state in goals:
            found, leaf = cost, path
            continue
        branches = [("I", i, follow(state), cost + INSERT)]
        if i < n:
            initial, must_go, cut = rows[i]
            branches.append(("D", i + 1, state, cost + DELETE))
            if not must_go:
                stay = cost + (CUT_OFF if cut else KEEP)
                kept = step(state, initial)
                if kept >= 0:
                    branches.append(("K", i + 1, kept, stay))
                branches.append(("R", i + 1, follow(state), stay + REROLE))
        ranked = sorted((c + bound[j][_BOUND[s]], letter, j, s, c) for letter, j, s, c in branches)
        for f, letter, j, s, c in reversed(ranked):         # the most promising branch is taken up first
            if f < NEVER and f <= found:
                stack.append((f, j, s, c, tree.add(path, letter)))
    return None if leaf < 0 else (found, "".join(tree.pieces(leaf)))


class Chain:
    """The blocks of one conversation, chained as they come."""

    def __init__(self) -> None:
        self.tree, self.at = Edits(), {START: (0, 0)}

    def add(self, rows: list[tuple[str, bool, bool]], last: bool) -> None:
        new: dict[int, tuple[int, int]] = {}
        for entry, (cost, path) in self.at.items():
            for goals in ([WHOLE] if last else [(s,) for s in STATES]):
                got = search(rows, entry, goals)
                if got is None:
                    continue
                here, state = (cost + got[0], self.tree.add(path, got[1])), goals[0]
                if state not in new or here[0] < new[state][0] or (here[0] == new[state][0] and self.tree.before(here[1], new[state][1])):
                    new[state] = here
        self.at = new

    def answer(self) -> tuple[int, list[str]]:
        cost, path = self.at[WHOLE[0]]
        return cost, self.tree.pieces(path)


# ---- all conversations

PIECE = "conv_id {id}, block long, audit string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal")


class Reader:
    """Codes of one conversation's rows in order: counts its faults and searches it block by block."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.chain, self.rows, self.pieces = conv_id, Chain(), [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.before = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, initial: str, blank: bool, again: bool, cut: bool) -> None:
        if len(self.rows) == BLOCK:
            self.chain.add(self.rows, False)
            self.rows = []
        again, cut = again and not blank, cut and not blank and not again
        self.blank += blank
        self.duplicate += again
        self.truncated += cut
        if self.before is not None:
            self.illegal += (self.before, initial) not in (("s", "u"), ("u", "a"), ("a", "u"))
        self.before = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.rows.append((initial, blank or again, cut))

    def close(self) -> Iterator[tuple]:
        self.chain.add(self.rows, True)
        cost, pieces = self.chain.answer()
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        for i, piece in enumerate(pieces):
            yield self.conv_id, i, piece, cost, gaps, self.blank, self.duplicate, self.truncated, self.illegal


class Digest:
    """The repaired conversation as a running digest."""

    def __init__(self, conv_id: object, row: dict) -> None:
        self.conv_id, self.sha, self.state, self.any, self.audit, self.at = conv_id, hashlib.sha256(), START, False, [], 0
        self.figures = [row["cost"], *[row[c] for c in FIGURES]]

    def put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put("assistant" if self.state == USER else "user", "")
            self.state = follow(self.state)
            self.at += 1

    def add(self, role: str, text: str) -> None:
        if isinstance(self.audit, list):
            self.audit = "".join(self.audit)
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.put(role, text)
            self.state = step(self.state, role[:1])
        elif edit == "R":
            self.put("assistant" if self.state == USER else "user", text)
            self.state = follow(self.state)

    def close(self) -> tuple:
        self.audit = "".join(self.audit)
        self.inserts()
        cost, *rest = self.figures
        return self.conv_id, *rest, cost, self.audit, self.sha.hexdigest()


def _tuples(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4096) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 1 + sum(len(v) for v in r if isinstance(v, str)) // 256
        if size >= limit:
            yield _out(held, schema)
            held, size = [], 0
    if held:
        yield _out(held, schema)


def repair(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): its faults, the cheapest edits and the repaired digest.

    ``copies`` says how often a row stands in its conversation; a conversation all of whose rows stand nowhere is an empty one.
    """
    bound_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType
    id_type, id_arrow = kind.simpleString(), (pa.string() if kind.simpleString() == "string" else pa.int64())
    n = (F.lit(1) if copies is None else copies).cast("int").alias("copies")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), n)
    rows = rows.withColumn("digest", F.when(F.col("copies") > 0, F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    rows = rows.withColumn("text", F.when(F.col("copies") > 0, F.col("text")))

    end = F.rtrim(F.col("text"), F.lit(WHITE))
    codes = rows.select("conv_id", "turn", "digest", "copies", F.left("role", F.lit(1)).alias("initial"), (end == "").alias("blank"),
                        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("turn")) > 1
    codes = codes.repartition("conv_id").withColumn("again", again).sortWithinPartitions("conv_id", "turn", "digest")
    schema = pa.schema([("conv_id", id_arrow), ("block", pa.int64()), ("audit", pa.string()), *[(c, pa.int64()) for c in ("cost", *FIGURES)]])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            reader = None
            for conv, turn, copies, initial, blank, again, cut in _tuples(batches, ("conv_id", "turn", "copies", "initial", "blank", "again", "cut")):
                if reader is None or reader.conv_id != conv:
                    if reader is not None:
                        yield from reader.close()
                    reader = Reader(conv)
                for i in range(copies):
                    reader.add(turn, initial, blank, again or i > 0, cut)
            if reader is not None:
                yield from reader.close()
        yield from _batched(each(), schema)

    pieces = materialise(codes.mapInArrow(solve, PIECE.format(id=id_type)), "audits")
    both = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "copies", "role", "text").unionByName(
        pieces.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "block", "turn", "digest")
    done = pa.schema([("conv_id", id_arrow), *[(c, pa.int64()) for c in (*FIGURES, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    columns = ("conv_id", "kind", "copies", "role", "text", "audit", "cost", *FIGURES)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            held = None
            for conv, kind, copies, role, text, audit, cost, *figures in _tuples(batches, columns):
                if held is None or held.conv_id != conv:
                    if held is not None:
                        yield held.close()
                    held = Digest(conv, dict(zip(("cost", *FIGURES), (cost, *figures))))
                if kind == 0:
                    held.audit.append(audit)
                else:
                    for _ in range(copies):
                        held.add(role, text)
            if held is not None:
                yield held.close()
        yield from _batched(each(), done)

    out = ", ".join(f"{c} long" for c in (*FIGURES, "cost"))
    return both.mapInArrow(digest, f"conv_id {id_type}, {out}, audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """The set damage of the contract: every row's fate follows from a checksum of its conversation and turn; adds ``copies``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return turns.select("conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                        F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair all conversations after damage."""
    hurt = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair(hurt, F.col("copies"))


QUERIES = {"op11_turn_repair": op11_turn_repair}
