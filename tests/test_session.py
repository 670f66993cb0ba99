import os

import pytest

import __spark_entry__
from lexivane import session


class FakeSession:
    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession)
    FakeSession.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession)


def test_scratch_deletes_what_was_written_in_it(spark):
    with session.scratch():
        kept = session.cut(spark.range(5), "t")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert kept.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_queries_without_the_optional_subpackage(monkeypatch):
    """Also when a folder without sources is left of it."""
    monkeypatch.setattr(__spark_entry__, "_OPTIONAL", ["lexivane.gone.queries", "lexivane.plans.gone"])
    assert "exact_topk" in __spark_entry__.queries() and "p1_found" in __spark_entry__.oracle_sql()
