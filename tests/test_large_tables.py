"""What queries send through exchanges and keep between passes."""

import numpy as np
import pytest

from compovec.operators import logistic as Q
from compovec.operators import ranks as R
from compovec.plans import load_catalogue


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Thirty customers with lines of orders."""
    path, rng, n = str(tmp_path_factory.mktemp("orders")), np.random.default_rng(4), 30
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    write([(i, "n", 1, 10.0 + i, "BUILDING") for i in range(1, n + 1)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "customer")
    write([(o, int(rng.integers(1, n + 1)), "FO"[int(rng.integers(0, 2))], float(rng.integers(1, 999))) for o in range(4 * n)],
          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", "orders")
    write([(o, int(rng.integers(1, 99)), int(rng.integers(1, 99)), j, float(rng.integers(1, 50)), float(rng.integers(0, 10)) / 100, "R") for o in range(4 * n) for j in range(1, 6)],
          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string", "lineitem")
    return path


def test_score_correlations_rank_by_one_number(spark, orders, monkeypatch):
    seen, real = [], R.spearman
    monkeypatch.setattr(R, "spearman", lambda df, x, y, by, *args: seen.append([df.schema[c].dataType.simpleString() for c in by]) or real(df, x, y, by, *args))
    got = load_catalogue()["score_correlations"].run(spark, orders).toPandas()
    assert seen == [["int"]]
    assert len(got) == len(got[["domain_id", "score"]].drop_duplicates()) == 76 and got["raw"].notna().any() and got["clr"].notna().any()


def test_selections_are_read_from_a_file_by_every_pass(spark, orders, monkeypatch):
    seen, real = [], Q.fit
    monkeypatch.setattr(Q, "fit", lambda d, *args, **kw: seen.append((d.is_cached, {f.rsplit("/", 1)[0].rsplit("/", 1)[1].split("-")[0] for f in d.inputFiles()})) or real(d, *args, **kw))
    got = load_catalogue()["selection_auroc"].run(spark, orders).toPandas()
    assert seen == [(False, {"selections"})] and set(got["source"]) == {"top", "random", "full"}


def test_report_files_are_written_by_many_tasks(spark, tmp_path):
    pages = [(i, f" <p>{i}</p> ") for i in range(40)] + [(3, " <p>3</p> ")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = load_catalogue()["report_files"].run(spark, str(tmp_path))
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in got.inputFiles()}) > 4
    assert sorted(int(r["report_id"]) for r in got.collect()) == list(range(40))          # rows of one page are one text, as from one split
    assert got.rdd.getNumPartitions() <= 32
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
