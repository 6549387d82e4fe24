"""Rules of plain patterns score as their patterns do, a batch at a time."""

import re

import pytest

from compovec.operators import rules as R

SENTENCES = ["", " ", "the thon, on", "th.", "a th b", "athx", "thon", "th on", "thaon", "THON", "\u00e9th ", "th\u00e9on", "\U0001f600th,", "on\nth ", "\u3000", None,
             "x" * 5000 + "th[a-z]?on", "erth thzon th ,"]


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def rules() -> R.RuleSet:
    return R.RuleSet({"a": [("thon", 2.0), ("th[a-z]?on", 1.0), ("(^| )th[ ,.]", 0.1)], "b": [("on", 1.0), ("^th", 0.3)], "c": []}, {"a": [("er", -1.0)], "b": [("er|x", -0.7)]}, ["b", "a"])


def test_plain_rules_score_as_their_patterns(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SENTENCES)], "i int, sentence string")
    r = rules()
    scored = R.scores(df, r)
    assert "RLIKE" not in plan(scored) and "Contains(" not in plan(scored)

    def want(s, d):
        total = 0.0
        for p, w in r.keywords[d] + r.negative.get(d, []):
            total += w if s is not None and re.search(p, s) else 0.0
        return total

    for row in scored.collect():
        assert [x["score"] for x in row["scores"]] == [want(row["sentence"], d) for d in "abc"], row["sentence"]
    one = {x["i"]: x["labels"] for x in R.classify(df, r, fallback="none").collect()}
    assert one[0] == one[1] == one[14] == one[15] == ["none"] and one[2] == ["a", "b"] and one[3] == ["none"] and one[6] == ["a", "b"]


def test_other_patterns_keep_their_engine(spark):
    df = spark.createDataFrame([("thon",), ("TH on",)], "sentence string")
    r = R.RuleSet({"a": [("(?i)th", 1.0)], "b": [("th(?=on)", 1.0), ("on", 2.0)], "c": [("on", 1.0)]})
    scored = R.scores(df, r)
    assert [[x["score"] for x in row["scores"]] for row in scored.collect()] == [[1.0, 3.0, 1.0], [1.0, 2.0, 1.0]]
    assert "RLIKE" in plan(scored)


@pytest.mark.parametrize("pattern, plain", [("th", True), ("(^| )th[ ,.]", True), ("a[a-z]?b", True), ("a|b", True), ("a.b", False), ("a\\b", False), ("a$", False), ("(?:a)", False),
                                            ("a++", False), ("^*a", False), ("a{2}", False), ("[^a]", False), ("\u00e9", True), ("", False)])
def test_alike(pattern, plain):
    assert R.alike(pattern) is plain
