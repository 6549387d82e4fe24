import pytest


@pytest.fixture(scope="session", autouse=True)
def scratch(spark, tmp_path_factory):
    """A scratch folder where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("scratch")))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, a clashing column."""
    long = "alpha beta gamma delta epsilon zeta eta theta. " * 3000
    rows = [(1, None, "x"), (2, "", None), (3, "one two three four five six", "x"), (4, "one two three four five six", "y"), (4, "one two three four five six", "y"),
            (None, "one two three four five six", "z"), (5, "a b", "x"), (6, "A B", "x"), (7, long, "x"), (8, long + "end", "x"), (9, "  \n\t ", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string")
