import re

import pytest
from pyspark.sql import functions as F

from compovec.functions import responses as J
from compovec.functions import text as T
from compovec.operators import labels as L
from compovec.operators import rules as R
from compovec.operators import segment
from compovec.operators import votes as V
from compovec.sources import ontology


def sentences(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [r["sentence"] for r in segment.segment_sentences(df, ["id"]).orderBy("sentence_idx").collect()]


def test_short_pieces_join_the_sentence_before(spark):
    long = "This sentence is long enough to stand alone"
    assert sentences(spark, f"Hi. {long}. No. Yes! {long} again") == ["Hi.", f"{long}. No. Yes!", f"{long} again"]


def test_first_piece_stands_and_blank_text_gives_nothing(spark):
    assert sentences(spark, "Ok") == ["Ok"]
    assert sentences(spark, " \n\t ") == []


def test_shielded_points_do_not_split(spark):
    a = 'The score was 1.2.3 (see ex. one. two!) and he said "stop. now?" to everyone here.'
    assert sentences(spark, a) == [a]
    b = "“Nothing. Here.” ends this sentence that is long. And a second one that is also long enough."
    assert len(sentences(spark, b)) == 2


def test_cleaning_matches_a_plain_restatement(spark):
    raw = "  a\n\nb\t\tc   d__e--f..g*h_-  "
    want = re.sub(r"([_\-.])\1+", r"\1", re.sub(" +", " ", re.sub("[\n\t]+", " ", raw))).replace("*", "").strip()
    got = spark.createDataFrame([(raw,)], "t string").select(T.clean_text(F.col("t"))).first()[0]
    assert got == want


def test_unknown_method_is_rejected(spark):
    with pytest.raises(ValueError):
        segment.segment_array(spark.createDataFrame([("x",)], "text string"), method="other")


def test_ids(spark):
    df = spark.createDataFrame([("AB-01-2-P03",), ("AB-01-A1",)], "r string")
    rows = df.select(T.report_type(F.col("r")), T.person_id(F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [("P", "AB-01"), ("A", "AB")]


A, B = ontology.ids()[0], ontology.ids()[1]


def vote(spark, *texts, errors=None):
    errors = errors or [None] * len(texts)
    rows = [("r", 0, i, t, e) for i, (t, e) in enumerate(zip(texts, errors))]
    return V.parse_votes(spark.createDataFrame(rows, "report_id string, sentence_idx int, vote_no int, response_text string, error string"))


def item(d, c, why="w"):
    return f'{{"domain_id": "{d}", "confidence": {c}, "rationale": "{why}"}}'


def test_responses_in_every_wrapping(spark):
    texts = [
        "note ```json\n{\"labels\": [%s]}\n``` end" % item(A, 0.5),
        "{\"labels\": [%s, ]}" % item(A, 0.5),
        "{\"labels\": [%s" % item(A, 0.5),
        "x {\"label\": %s} y" % item(A, 0.5),
        "{\"labels\": [\"s\", %s, %s, %s]}" % (item("nope", 1), item(A, 1.7), item(A, 0.1)),
        "{\"labels\": [{\"domain_id\": \"%s\", \"confidence\": null}, {\"domain_id\": \"%s\", \"confidence\": \"high\"}, {\"domain_id\": \"%s\"}]}" % (A, A, B),
        "nothing here", "{\"labels\": 3}",
    ]
    got = {r["vote_no"]: [(x["domain_id"], x["confidence"]) for x in r["items"]] for r in vote(spark, *texts).collect()}
    assert got == {0: [(A, 0.5)], 1: [(A, 0.5)], 2: [(A, 0.5)], 3: [(A, 0.5)], 4: [(A, 1.0)], 5: [(B, 0.0)], 6: [], 7: []}


def test_a_response_that_is_not_an_object_fails_the_sentence(spark):
    r = V.consolidate(vote(spark, "[1, 2]", "{}"), n_votes=2).first()
    assert r["labels"] == [] and r["error"]


def test_majority_threshold_order_cap_and_fallback(spark):
    full = lambda *it: "{\"labels\": [%s]}" % ", ".join(it)
    c, d, e = ontology.ids()[2:5]
    texts = [full(item(A, 0.6), item(B, 0.9), item(c, 0.9), item(d, 0.8), item(e, 0.2)) for _ in range(3)] + [full(), full()]
    r = V.consolidate(vote(spark, *texts)).first()
    assert [x["domain_id"] for x in r["labels"]] == [B, c, d]          # tie by first seen, cap of three
    two_of_five = [full(item(A, 0.9))] * 2 + [full()] * 3
    r = V.consolidate(vote(spark, *two_of_five)).first()
    assert [(x["domain_id"], x["confidence"]) for x in r["labels"]] == [(ontology.FALLBACK, 0.9)]
    r = V.consolidate(vote(spark, *texts[:4], None, errors=[None] * 4 + ["boom"])).first()
    assert r["labels"] == [] and r["error"] == "boom"


def test_repair_appends_missing_closers(spark):
    got = spark.createDataFrame([('{"a": [1, {"b": 2',)], "t string").select(J.repair_json(F.col("t"))).first()[0]
    assert got == '{"a": [1, {"b": 2}]}'


def test_rules_score_rank_and_fall_back(spark):
    rules = R.RuleSet({A: [("cat", 1.0), ("ca[rt]", 1.0)], B: [("dog", 2.0)]}, {A: [("not", -2.0)]}, priority=[B, A])
    df = spark.createDataFrame([("cat dog",), ("not cat",), ("  ",), ("bird",)], "sentence string")
    assert [r["labels"] for r in R.classify(df, rules).collect()] == [[B, A], ["other_general"], ["other_general"], ["other_general"]]


def test_gold_cells(spark):
    df = spark.createDataFrame([("r", 0, "s", " co1 , CO1,zz, other_general "), ("r", 1, "s", ""), (None, 2, None, "CO1")],
                               "report_id string, sentence_idx int, sentence string, domain_code string")
    rows = L.convert_gold(df).orderBy("sentence_idx").collect()
    assert [r["labels"] for r in rows] == [[A, "other_general"], ["other_general"]]
    assert rows[0]["unknown"] == ["zz"]
    assert L.header_mismatches(["report_id", "idx", "sentence", "domain_code"]) == [(2, "idx", "sentence_idx")]


def test_nested_labels_keep_the_largest_confidence(spark):
    df = spark.createDataFrame([([(A, 0.2), (B, None), (A, 0.7)],), ([],)], "labels array<struct<domain_id:string,confidence:double>>")
    rows = [[tuple(x) for x in r["labels"]] for r in L.canonical_nested(df).collect()]
    assert rows == [[(A, 0.7), (B, 0.0)], [("other_general", 0.0)]]


def test_fence_pattern_runs_only_where_its_mark_occurs(spark):
    rows = ["```json {\"a\": 1} ``` tail}", "``` open {\"a\": 2}", "`` {\"a\": 3} ``", "  none ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", J.extract_json(F.col("t")).alias("raw"))
    assert "contains(t" in df._jdf.queryExecution().analyzed().toString().lower()
    assert [r["raw"] for r in df.orderBy("i").collect()] == ['{"a": 1}', '{"a": 2}', '{"a": 3}', "none", None]


def vote_files(spark, tmp_path, parts):
    """Votes of two reports as one file for each list of (report, sentence, vote) keys, and their stream of one file a trigger."""
    schema = "report_id string, sentence_idx int, vote_no int, response_text string, error string"
    for i, keys in enumerate(parts):
        rows = [(r, s, v, '{"labels": [{"domain_id": "%s", "confidence": 0.9}]}' % (A if s and s % 2 else B), None) for r, s, v in keys]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streamed_sentences_share_state_entries(spark, tmp_path):
    """Every sentence once, as the batch operator has it; the state has an entry per block of sentences, not per sentence."""
    from compovec.streaming import votes as stream
    keys = [(r, s, v) for r in ("a", "b", None) for s in (*range(70), None) for v in range(3)]
    late = [("a", 3, 0), ("a", 69, 2), ("b", 200, 0)]
    source = vote_files(spark, tmp_path, [keys[::2] + late[:1], keys[1::2], late])
    q = stream.start(source, str(tmp_path / "out"), str(tmp_path / "checkpoint"), n_votes=3)
    q.awaitTermination()
    got = [(r["report_id"], r["sentence_idx"], [x["domain_id"] for x in r["labels"]], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = {(r, s): [A if s and s % 2 else B] for r, s, _ in keys}
    none = V.consolidate(V.parse_votes(spark.read.parquet(str(tmp_path / "in"))).filter("sentence_idx is null"), n_votes=3).count()
    assert len(got) == len(want) and {(r, s): d for r, s, d, _ in got} == want and none == 3
    assert all(e is None for *_, e in got)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 10        # two blocks and a null index for three reports, and one late block


def test_streamed_sentences_are_released_after_the_timeout(spark, tmp_path):
    import time
    from compovec.streaming import votes as stream
    source = vote_files(spark, tmp_path, [[("a", 0, v) for v in range(3)] + [("a", 1, 0), ("a", 2, 1)]])
    released = stream.released_votes(V.parse_votes(source), 3, 1500)
    q = released.writeStream.format("memory").queryName("released").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("released").count() < 5:
            time.sleep(0.5)
        got = sorted((r["sentence_idx"], r["vote_no"]) for r in spark.table("released").collect())
    finally:
        q.stop()
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 1)]
