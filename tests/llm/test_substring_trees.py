"""Substring dedup against brute force, and its tree against sorted suffixes."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from compovec.llm import substring_trees as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - 49):
                k = tuple(w[i:i + 50])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in texts:
        gone = set()
        if d is not None:
            for i in range(len(w) - 49):
                if first[tuple(w[i:i + 50])] < d:
                    gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in st.remove_repeats(df).collect()), key=str)


def planted(rng):
    """Passages shared whole, in part and with edits; periodic texts; copies; templates with own words."""
    vocab = np.array([f"w{i}" for i in range(300)] + ["é", "中", "a,b"])
    word = lambda n: rng.choice(vocab, n).tolist()
    passages = [word(int(rng.integers(45, 160))) for _ in range(6)]
    template = word(120)
    rows = []
    for i in range(90):
        w = word(int(rng.integers(0, 80)))
        for _ in range(int(rng.integers(0, 3))):
            p = list(passages[int(rng.integers(len(passages)))])
            a, e = sorted(rng.integers(0, len(p) + 1, 2).tolist()) if rng.random() < .3 else (0, len(p))
            if rng.random() < .3 and p:
                p[int(rng.integers(len(p)))] = f"x{i}"
            w += p[a:e] + word(int(rng.integers(0, 30)))
        if i % 6 == 0:
            t = list(template)
            t[int(rng.integers(len(t)))] = f"y{i}"
            w = t
        rows.append((int(rng.integers(0, 200)), [" ", "\n", "\t ", "  "][i % 4].join(w)))
    rows += [(300 + i, "a b c " * n) for i, n in enumerate((10, 16, 17, 40, 41, 900))] + [(310, "z " * 49), (311, "z " * 50), (312, "z " * 51), (309, "z " * 60)]
    rows += [(400 + i, rows[7][1]) for i in range(5)] + [(None, rows[7][1]), (None, None), (None, "q " * 70), (2, None), (3, "")] + rows[:4]
    return rows


def test_repeats(spark):
    rows = planted(np.random.default_rng(11))
    assert sum(r[2] > 0 for r in brute(rows)) > 30
    df = spark.createDataFrame([(*r, 1, [1]) for r in rows], "doc_id long, text string, print int, spans array<int>").repartition(5)
    assert found(df) == brute(rows)


@pytest.mark.parametrize("classes, group", [(1, 400), (2, 4000), (1, 50)])
def test_longer_prefixes(spark, monkeypatch, classes, group):
    """Tiny groups: anchors are split by longer prefixes, down to single windows."""
    monkeypatch.setattr(st, "GROUP_CLASSES", classes)
    monkeypatch.setattr(st, "GROUP_WORDS", group)
    rows = planted(np.random.default_rng(12))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_and_empty(odd, none):
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert st.remove_repeats(none).count() == 0


def test_tree_is_the_sorted_suffixes():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(1, 60, 5)
        word = rng.integers(0, 3, sizes.sum()).astype(np.uint64)
        last = np.cumsum(sizes)
        end = np.repeat(last, sizes)
        depth = int(rng.integers(1, 12))
        leaves = rng.permutation(len(word))[:60]
        order, parts = st.suffix_tree(word, end, leaves, depth)
        suffix = {int(i): word[i:end[i]].tolist() for i in leaves}
        assert sorted(order.tolist()) == sorted(leaves.tolist())
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        for at in range(1, len(order)):
            want = common(suffix[int(order[at])], suffix[int(order[at - 1])])
            assert parts[at] == want or min(parts[at], want) >= depth
        value = rng.integers(0, 100, len(order))
        got = st.first_below(parts, value, depth)
        for i, a in enumerate(order):
            same = [value[j] for j, b in enumerate(order) if i == j or common(suffix[int(a)], suffix[int(b)]) >= depth]
            assert got[i] == min(same)


def test_segments_follow_content():
    """Equal windows have equal anchors and, inside equal segments, equal hashes, wherever they stand."""
    rng = np.random.default_rng(3)
    shared = " ".join(f"s{i}" for i in rng.integers(0, 500, 200))
    texts = pa.array(["x y z " + shared, shared + " tail", " ".join(f"t{i}" for i in range(70)) + " " + shared, "a " * 400])
    rows, h, _ = st.word_hashes(texts)
    s = st.segments(rows, h)
    assert s["windows"].sum() == sum(max(len(t.as_py().split()) - 49, 0) for t in texts)
    by_row = [set(zip(s["gram"][s["row"] == r].tolist(), s["seg"][s["row"] == r].tolist())) for r in range(4)]
    assert len(by_row[0] & by_row[1]) >= 3 and len(by_row[0] & by_row[2]) >= 3 and len(by_row[3]) == 1
