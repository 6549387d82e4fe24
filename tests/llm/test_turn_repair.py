"""Conversation repair against a plain dynamic program over (cost, audit), and small cases by enumeration."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np

from compovec.llm import turn_repair as tr


def plain(rows):
    """Least (cost, audit, repaired) of rows (role, text, must go, truncated), by relaxing all states row by row."""
    def inserts(at):
        for _ in range(6):
            for q, (c, audit, done) in list(at.items()):
                role = "assistant" if q == "u" else "user"
                new = (c + 5, audit + "I", done + [(role, "")])
                to = "a" if q == "u" else "u"
                if to not in at or new[:2] < at[to][:2]:
                    at[to] = new
        return at
    at = inserts({"": (0, "", [])})
    for role, text, gone, cut in rows:
        new = {}

        def put(q, v):
            if q not in new or v[:2] < new[q][:2]:
                new[q] = v
        for q, (c, audit, done) in at.items():
            put(q, (c + 2, audit + "D", done))
            if gone:
                continue
            stay = c + (5 if cut else 0)
            fits = {"": "su", "s": "u", "u": "a", "a": "u"}[q]
            if role[:1] and role[:1] in fits:
                put(role[:1], (stay, audit + "K", [*done, (role, text)]))
            to = "assistant" if q == "u" else "user"
            put(to[0], (stay + 1, audit + "R", [*done, (to, text)]))
        at = inserts(new)
    return min((at[q] for q in ("", "a") if q in at), key=lambda v: v[:2])


def whole(rows):
    """The contract's row for one conversation's (turn, role, text) rows in order."""
    seen, coded, counts = set(), [], collections.Counter()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        coded.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, *_ in rows if t is not None]
    cost, audit, done = plain(coded)
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())


def digest_order(r):
    turn, role, text = r
    return (turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def damaged(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        here = convs[conv]
        if fate:
            role = "user" if fate == 4 else role
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            here += [(turn, role, text)] * (2 if fate == 3 else 1)
    return {c: whole(sorted(r, key=digest_order)) for c, r in convs.items()}


def as_dict(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_search_is_optimal():
    kinds = list(itertools.product("sua ", (False, True), (False, True)))
    for rows in itertools.product([k for k in kinds if not (k[1] and k[2])], repeat=3):
        assert tr.search(list(rows)) == plain([(a, "", g, c) for a, g, c in rows])[:2]
    rng = np.random.default_rng(3)
    for _ in range(400):
        rows = [("sua x"[int(rng.integers(5))].strip(), bool(rng.random() < .2), bool(rng.random() < .3)) for _ in range(int(rng.integers(0, 40)))]
        assert tr.search(rows) == plain([(a, "", g, c) for a, g, c in rows])[:2]


def test_blocks_chain_to_the_optimum():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 7):
        for _ in range(60):
            rows = [("sua"[int(rng.integers(3))], bool(rng.random() < .2), bool(rng.random() < .3)) for _ in range(int(rng.integers(1, 30)))]
            chain = tr.Chain()
            parts = [rows[i:i + size] for i in range(0, len(rows), size)]
            for i, p in enumerate(parts):
                chain.add(p, i == len(parts) - 1)
            cost, pieces = chain.answer()
            assert (cost, "".join(pieces)) == plain([(a, "", g, c) for a, g, c in rows])[:2]


def test_hard_conversations_stay_small():
    """Many system turns, where the bound is loosest, and a long one-sided conversation."""
    for rows in ([("s", False, False)] * 1000, [("s", False, True)] * 500 + [("u", False, False)] * 500, [("a", False, False)] * 1000):
        assert tr.search(rows) == plain([(a, "", g, c) for a, g, c in rows])[:2]


def test_conversations(spark):
    rng = np.random.default_rng(6)
    texts = ["Fine.", "Why?", "cut off", "", " \n", None, "Good! ", "x" * 40_000 + ".", "é…", "a.b"]
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    rows = [(int(rng.integers(0, 90)), None if rng.random() < .05 else int(rng.integers(-2, 12)),
             roles[int(rng.integers(3 if rng.random() < .8 else 7))], texts[int(rng.integers(len(texts)))]) for _ in range(700)]
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Yes."), (-5, None, "user", "x"), *rows[:20]]
    rows += [(1000, i, ["user", "assistant", "system"][i % 3 if i % 7 else 0], texts[i % 5]) for i in range(3000)]      # several blocks
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(7)
    got = as_dict(tr.repair(tr.damage(df), tr.F.col("copies")))
    want = damaged(rows)
    assert got == want and len(want[1000][6]) >= 2500


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert tr.repair(spark.createDataFrame([], schema)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out = tr.repair(tr.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema)), tr.F.col("copies"))
    assert as_dict(out) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
