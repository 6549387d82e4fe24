"""Queries that use one derived table twice derive it once."""

import pytest

from compovec.plans import load_catalogue
from compovec.sources import sinks


def reports(spark, path, n=6):
    text = "The first sentence of this text is long enough. The second one of it is long enough as well."
    spark.createDataFrame([(i, text, "en", "x", len(text)) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{path}/documents.parquet")
    return str(path)


def scans_text(df):
    return any("documents.parquet" in f for f in df.inputFiles())


@pytest.mark.parametrize("name", ["modal_agreement_by_domain", "votes_per_sentence"])
def test_votes_are_parsed_once_for_both_sides(spark, tmp_path, name):
    df = load_catalogue()[name].run(spark, reports(spark, tmp_path))
    assert df.count() and not scans_text(df)


@pytest.mark.parametrize("name, sink, given", [("appended_labels", "append_labels", 1), ("match_metadata_file", "export_details", 2)])
def test_sinks_get_a_table_that_is_derived_once(spark, tmp_path, monkeypatch, name, sink, given):
    seen, real = [], getattr(sinks, sink)

    def spy(*args, **kw):
        seen.extend(args[:given])
        return real(*args, **kw)

    monkeypatch.setattr(sinks, sink, spy)
    row = load_catalogue()[name].run(spark, reports(spark, tmp_path)).first()
    assert row[0] == 12 and len(seen) == 2 and not any(scans_text(d) for d in seen)


def test_label_sets_are_paired_once_for_scores_and_count(spark, tmp_path):
    df = load_catalogue()["sentence_level_agreement"].run(spark, reports(spark, tmp_path))
    assert df.count() == 1 and not scans_text(df)


def test_vote_reliability_is_joined_once_for_rates_and_confidence(spark, tmp_path):
    df = load_catalogue()["modal_agreement_by_domain"].run(spark, reports(spark, tmp_path))
    assert df.count() and all("/reliability-" in f for f in df.inputFiles())


def test_distances_are_worked_out_once_for_percentiles_and_powers(spark, monkeypatch):
    import numpy as np

    from compovec.operators import ranks as R
    from compovec.plans.multivariate import heavy_tail_by
    x = np.random.default_rng(6).normal(size=(60, 6))
    df = spark.createDataFrame([("ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "setting string, v array<double>")
    seen, real = [], R.percentiles
    monkeypatch.setattr(R, "percentiles", lambda long, *args, **kw: seen.extend(long.inputFiles()) or real(long, *args, **kw))
    got = heavy_tail_by(df, "v", "setting")
    assert seen and all("/distances-" in f for f in seen) and [r["n"] for r in got] == [30, 30]
