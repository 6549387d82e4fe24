"""The filter audit against a plain replay of every order, and its sketch against exact counts."""

import collections
import itertools
import re

import numpy as np
import pytest

from compovec.llm import filter_audit


def fails(rows):
    smallest = {}
    for d, t, _ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    for d, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield {c for c, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                                             bool(re.search("[#$%&*|]", t)), d is not None and d > smallest[t])) if bad}


def replay(rows, labels):
    bad = list(fails(rows))
    out = {}
    parts = collections.defaultdict(list)
    for i, (_, _, s) in enumerate(rows):
        parts[s or ""].append(i)
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    for part, ids in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(ids)
            for step, f in enumerate(order, 1):
                removed = [i for i in left if f in bad[i]]
                gone = [i for i in ids if i not in left]
                left = [i for i in left if f not in bad[i]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), sum(f in bad[i] for i in gone), sum(bad[i] == {f} for i in ids),
                                                   sum(rows[i][0] in good for i in removed), sum(rows[i][0] in toxic for i in removed), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return out


def as_dict(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(400)] + ["Aa", "BB", "a#", "x|y", "é"])
    texts = [" ".join(rng.choice(words[:int(rng.integers(2, 405))], int(rng.integers(1, 420)))) for _ in range(60)]
    texts += ["", None, "  \n", "PLAIN " * 30, "long text & more " * 9000]
    return [(int(rng.integers(0, 150)) if rng.random() > .05 else None, texts[int(rng.integers(len(texts)))], [None, "", "a", "b"][int(rng.integers(4))])
            for _ in range(220)]


def test_every_order(spark, mixed):
    rows = mixed + mixed[:3]                                # repeated rows
    labels = [(i, i % 2, (i // 2) % 3) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, source string, mask int, maybe boolean").repartition(5)
    got = as_dict(filter_audit.interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == replay(rows, labels)


def test_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(none, labels, part="score").count() == 0
    rows = [(r.doc_id, r.text, r.score) for r in odd.collect()]
    assert as_dict(filter_audit.interactions(odd, labels, part="score")) == replay(rows, [])


def test_sketch_clears_only_unique_texts(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(-2 ** 62, 2 ** 62, 9_000)
    hashes = np.concatenate([hashes, hashes[:500], hashes[:1].repeat(3000)])
    df = spark.createDataFrame([(int(h),) for h in rng.permutation(hashes)], "hash long").repartition(7)
    bits = filter_audit.repeated_cells(df, len(hashes))
    flagged = {r.hash for r in df.where(filter_audit.possible_repeat(spark, bits)("hash")).collect()}
    repeated = set(hashes[:500].tolist())
    assert repeated <= flagged and len(flagged - repeated) < 90      # cells that chance shares: under one in a hundred
    # a sketch far too small flags more and still misses nothing
    assert repeated <= {r.hash for r in df.where(filter_audit.possible_repeat(spark, filter_audit.repeated_cells(df, 1))("hash")).collect()}
