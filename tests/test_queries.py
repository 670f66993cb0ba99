"""Registered queries against their SQL on the smallest tables: those with the longest plans, or with LEXIVANE_ALL_QUERIES=1 every one.

Here they have small knobs, so that full lists, dissolved clusters and skipped blocks occur on small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return repr(x)


SOME = ["exact_topk", "cluster_dissolve_reassign", "summary_quantised", "skip_topk_sorted", "knn_refine_topk", "cluster_inverted_dissolve", "pruned_topk_factor_zero", "rag_prompt", "recall_at_k", "ndcg_at_10", "prune_global", "best_config", "space_usage", "p1_found"]


def core():
    every = {k: v for m in __spark_entry__._MODULES for k, v in __import__(m, fromlist=["x"]).queries().items()}
    return every if os.environ.get("LEXIVANE_ALL_QUERIES") else {k: every[k] for k in SOME}


@pytest.mark.parametrize("name", sorted(core()))
def test_query(spark, duck, name):
    df = core()[name](spark, SF)
    rows = df.collect()
    cols = sorted(df.columns)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == want


def test_skipping_query_sums_lists_up_as_wholes(spark, duck, monkeypatch):
    """No entry of a list's vectors is shuffled for the summaries, and the rows are those of the SQL."""
    from lexivane.operators import summaries

    def refused(*_):
        raise AssertionError("entries are shuffled")

    monkeypatch.setattr(summaries, "block_max", refused)
    test_query(spark, duck, "skip_topk_sorted")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
