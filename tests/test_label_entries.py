"""Label entries of any shape, and that an entry costs one cast instead of a path look-up for each field."""

from compovec.operators import votes as V

SCHEMA = "report_id string, sentence_idx int, vote_no int, response_text string, error string"
ODD = ('{"labels": [1, {"domain_id": 5}, null, {"domain_id": null}, "text", [{"domain_id": "recommendations"}], {"domain_id": "\\u3000recommendations\\n"}, '
       '{"domain_id": "motor_skills", "confidence": null}, {"domain_id": "test_scores", "confidence": "0.5", "rationale": [1, "x"]}, '
       '{"domain_id": "language_skills", "confidence": {"a": 1}}, {"domain_id": "internalizing", "confidence": 7, "rationale": null}, {"domain_id": "externalizing", "confidence": -1}]}')
TEXTS = [ODD, "true", "null", "no answer", "nothing {", "-1", '{"labels": {"domain_id": "recommendations"}}', '{"label": ["recommendations"]}', '{"labels": null, "label": {"domain_id": "recommendations"}}',
         '{"labels": [], "label": {"domain_id": "recommendations"}}', '{"labels": [{"domain_id": "recommendations", "confidence": 0.25}', None]


def parsed(spark):
    return V.parse_votes(spark.createDataFrame([("r", 0, i, t, None) for i, t in enumerate(TEXTS)], SCHEMA).repartition(2))


def test_entries_of_any_shape(spark):
    got = {r["vote_no"]: (r["error"], [tuple(x) for x in r["items"]]) for r in parsed(spark).collect()}
    rec = ("recommendations", "RE3")
    bad = "response is not an object"
    assert got[0] == (None, [(*rec, 0.0, ""), ("test_scores", "RE1", 0.5, '[1,"x"]'), ("internalizing", "AS2", 1.0, ""), ("externalizing", "AS1", 0.0, "")])
    assert [got[i][0] for i in range(1, 12)] == [bad, bad, None, None, bad, None, None, None, None, None, None]
    assert [got[i][1] for i in range(1, 8)] == [[]] * 7 and got[9][1] == got[11][1] == []
    assert got[8][1] == [(*rec, 0.0, "")] and got[10][1] == [(*rec, 0.25, "")]


def test_an_entry_is_taken_apart_once(spark):
    plan = parsed(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(lambda") == 1
