"""Files, indexes and datasets."""

import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.config import Configuration
from lexivane.index import PackedIndex, RawIndex, SparseDataset, SparseIndex
from lexivane.operators import metrics, search, summaries, tuning
from lexivane.sources import records as sources

RECORDS = [
    {"id": 7, "content": "seven", "vector": {"a": 1.0, "b": 2.0}},
    {"id": "x", "content": None, "vector": {"b": 4.0, "c": 5.0}},
    {"id": "y", "vector": {"a": 1.0, "b": 2.0, "c": 3.0, "d": 4.0}},
    {"id": "empty", "vector": {}},
]
CONFIG = Configuration().pruned(kind="fixed", n_postings=100).blocked(kind="fixed", block_size=1).summarized(energy=1.0).with_value_type("f32")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    (path / "docs.jsonl").write_text("".join(json.dumps(r) + "\n" for r in RECORDS))
    with tarfile.open(path / "docs.tar.gz", "w:gz") as tar:
        tar.add(path / "docs.jsonl", "first.jsonl")
        (path / "other.txt").write_text("not read")
        tar.add(path / "other.txt", "second.txt")
    return path


def test_files_give_the_same_records(spark, folder):
    plain = sources.read_records(spark, str(folder / "docs.jsonl")).orderBy("id").collect()
    packed = sources.read_records(spark, str(folder / "docs.tar.gz")).orderBy("id").collect()
    assert plain == packed and [r.id for r in plain] == ["7", "empty", "x", "y"]
    with pytest.raises(ValueError):
        sources.read_records(spark, str(folder / "docs.csv"))
    (folder / "bad.jsonl").write_text('{"id": 1, "vector": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_records(spark, str(folder / "bad.jsonl")).collect()
    (folder / "pre.json").write_text(json.dumps({"vectors": [{"id": "p", "coordinates": ["1", "2"], "values": [0.5, 1.5]}]}))
    assert sources.read_pretokenised(spark, str(folder / "pre.json")).first().vector == {"1": 0.5, "2": 1.5}


def test_search_without_skipping_pairs_nothing(spark, folder, monkeypatch):
    """With factor 0 an index searches its lists as wholes: no pair of a query and a record is shuffled, and no summary is read."""

    def refused(*_):
        raise AssertionError("pairs are shuffled")

    index = SparseIndex.from_file(spark, str(folder / "docs.jsonl"), CONFIG)
    index.codes = index.codes.withColumn("low", F.raise_error(F.lit("read")).cast("double"))
    monkeypatch.setattr(search, "score", refused)
    queries = spark.createDataFrame([("q", {"a": 1.0, "b": 2.0}), ("none", {"z": 1.0})], "id string, vector map<string,double>")
    got = [tuple(r) for r in index.search_tokens(queries, 2, 1, 0.0).orderBy("rank").collect()]
    assert got == [("q", "x", 8.0, 1), ("q", "7", 5.0, 2)]


def test_an_index_shuffles_no_entry_of_a_vector_by_itself_for_summaries(spark, folder, monkeypatch):
    def refused(*_):
        raise AssertionError("each entry of each posting is shuffled")

    monkeypatch.setattr(summaries, "block_max", refused)
    config = Configuration().summarized(energy=1.0).with_value_type("f32")
    index = SparseIndex.from_file(spark, str(folder / "docs.jsonl"), config)
    assert sorted(map(tuple, index.codes.where("component = 3").select("c", F.round(F.col("low") + F.col("code") * F.col("step"), 6)).collect())) == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)]
    assert index.search("q", ["a", "b"], [1.0, 2.0], 2, 10, 0.9) == [("q", 8.0, "x"), ("q", 5.0, "7")]


def test_index_from_file(spark, folder):
    index = SparseIndex.from_file(spark, str(folder / "docs.jsonl"), CONFIG)
    assert (index.len, index.dim, index.nnz, index.is_empty, index.knn_len) == (4, 4, 8, False, 0)
    assert index.search("q", ["a", "b", "unknown"], [1.0, 2.0, 9.0], 2, 10, 0.0) == [("q", 8.0, "x"), ("q", 5.0, "7")]
    assert index.batch_search(["u", "v"], [["unknown"], ["d"]], [[1.0], [2.0]], 5, 10, 0.9) == [[], [("v", 8.0, "y")]]
    assert index.get_doc_text("7") == "seven" and index.get_doc_text("x") is None and index.get_doc_text("none") is None
    with pytest.raises(ValueError):
        index.save_knn(str(folder / "none"))
    index.build_knn(2)
    assert index.knn_len == 2
    refined = index.search("q", ["a"], [1.0], 3, 1, 0.0, n_knn=2)
    assert [r[2] for r in refined] == ["7", "y"]
    path = index.save(str(folder / "saved"))
    again = SparseIndex.load(spark, path)
    assert again.config == index.config and again.knn_len == 2
    assert again.search("q", ["a", "b"], [1.0, 2.0], 2, 10, 0.0) == index.search("q", ["a", "b"], [1.0, 2.0], 2, 10, 0.0)
    again.load_knn(index.save_knn(str(folder / "graph")), 1)
    assert again.knn_len == 1
    assert again.get(1)[1] == [1.0, 2.0] and len(again.get_doc_ids_in_postings(1)) == 3
    assert again.print_space_usage_byte() > 0
    small = again.convert("fixedu8")
    assert small.postings.count() == again.postings.count() and abs(small.search("q", ["d"], [1.0], 1, 1, 0.0)[0][1] - 4.0) < 0.02


def test_raw_index_and_binary_file(spark, folder):
    vectors = spark.createDataFrame([(0, [0, 2], [1.0, 2.0]), (1, [], []), (2, [1], [4.0])], "rec_no long, components array<int>, vals array<float>")
    path = str(folder / "vectors.bin")
    assert sources.write_inner(vectors, path) == 3
    back = sources.read_inner(spark, path).orderBy("ordinal").collect()
    assert [(r.ordinal, r.components, r.vals) for r in back] == [(0, [0, 2], [1.0, 2.0]), (1, [], []), (2, [1], [4.0])]
    assert np.fromfile(path, "<u4", 2).tolist() == [3, 2]
    forward = vectors.select("rec_no", F.explode(F.arrays_zip("components", "vals")).alias("e")).select("rec_no", F.col("e.components").alias("component"), F.col("e.vals").cast("double").alias("w"))
    index = RawIndex.build(forward, CONFIG)
    assert index.dim == 3 and index.search("q", [1, 99], [0.5, 1.0], 3, 5, 0.9) == [("q", 2.0, 2)]
    hits = {(r.query_id, r.rec_no): r.score for r in index.batch_search_file(path, 3, 5, 0.0).collect()}
    assert hits == {("0", 0): 5.0, ("2", 2): 16.0}
    with pytest.raises(Exception, match="must not be negative"):
        RawIndex.build(forward.withColumn("w", -F.col("w")), CONFIG)


def test_an_index_of_a_single_component(spark):
    forward = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0)], "rec_no long, component int, w double")
    index = RawIndex.build(forward, Configuration().with_value_type("f32"))
    assert index.dim == 1 and index.postings.count() == 2 and index.search("q", [0], [1.0], 1, 1, 0.0) == [("q", 2.0, 2)]
    assert RawIndex.build(forward.limit(0), Configuration()).dim == 0


def test_packed_index(spark, folder):
    index = PackedIndex.from_records(sources.number(sources.read_records(spark, str(folder / "docs.jsonl"))), CONFIG)
    assert abs(index.search("q", ["d"], [1.0], 1, 1, 0.0)[0][1] - 4.0) < 0.02
    with pytest.raises(NotImplementedError):
        index.get(1)
    with pytest.raises(NotImplementedError):
        index.build_knn(1)


def test_dataset_grows(spark):
    data = SparseDataset(spark)
    assert data.len == 0
    data.add_document("a", ["t", "u"], [1.0, 2.0], "text of a")
    data.add_document("b", ["u"], [1.0 + 2**-12])
    with pytest.raises(ValueError):
        data.add_document("c", ["t", "t"], [1.0, 2.0])
    assert data.search("q", ["u"], [1.0], 5) == [("q", 2.0, "a"), ("q", 1.0, "b")]
    data.add_records(spark.createDataFrame([("c", None, {"v": 1.0})], "id string, content string, vector map<string,float>"))
    assert data.len == 3 and data.get_doc_text("a") == "text of a" and data.get_doc_text("b") is None
    assert SparseIndex.from_dataset(data, CONFIG).search("q", ["v"], [2.0], 1, 1, 0.9) == [("q", 2.0, "c")]


def test_runs_judgements_and_reports(spark, folder):
    hits = spark.createDataFrame([("1", "a", 1, 2.0), ("1", "b", 2, 1.0), ("2", "c", 1, 1.0)], "query_id string, doc_id string, rank int, score double")
    sources.write_run(hits, str(folder / "run"))
    run = sources.read_run(spark, str(folder / "run"))
    assert run.count() == 3
    (folder / "q1.tsv").write_text("1\t0\ta\t0\n1\t0\tb\t2\n3\t0\tz\t1\n")
    (folder / "q2.tsv").write_text("1\ta\t0\t0\n1\tb\t2\t0\n3\tz\t1\t0\n")
    one, two = (sources.read_qrels(spark, str(folder / f)).orderBy("query_id", "doc_id").collect() for f in ("q1.tsv", "q2.tsv"))
    assert one == two
    found = {r.query_id: r for r in metrics.by_query(metrics.clean_run(run), metrics.clean_qrels(sources.read_qrels(spark, str(folder / "q1.tsv")))).collect()}
    assert (found["1"].rr, found["1"].ap, found["3"].rr) == (0.5, 0.5, 0.0) and abs(found["1"].ndcg - 1 / np.log2(3)) < 1e-12
    truth = hits.where("query_id = '1'").unionByName(spark.createDataFrame([("9", "a", 1, 1.0)], hits.schema))
    got = metrics.accuracy_at_k(hits, truth).first()
    assert (got.n_hits, got.n_truth) == (2, 3)
    assert metrics.summary(hits.limit(0).withColumnRenamed("rank", "rank"), metrics.clean_qrels(sources.read_qrels(spark, str(folder / "q1.tsv")))).first().mrr == 0.0
    sources.write_toml({"name": "x", "indexing": {"n": 3, "sorted": True, "f": [0.1, 0.2]}}, str(folder / "c.toml"))
    assert sources.read_toml(str(folder / "c.toml")) == {"name": "x", "indexing": {"n": 3, "sorted": True, "f": [0.1, 0.2]}}


def test_grids(spark):
    grid = tuning.combinations({"p": ["fixed", "global"], "f": [1, 2], "n": 5}, {"f": ("p", "global")})
    assert len(grid) == 3
    assert tuning.params_hash({"a": 1, "b": 2}) == tuning.params_hash({"b": 2, "a": 1})
    left, orphans = tuning.to_run(grid, {tuning.params_hash(grid[0]): 2, "gone": 1}, 2)
    assert len(left) == 2 and orphans == ["gone"]

    def build(params):
        if params["f"] == 2:
            raise RuntimeError("no")
        return params

    rows = tuning.run_grid(grid, build, {"q": {"cut": 1}}, lambda index, knobs: {"recall": 0.95, "cut": knobs["cut"]})
    assert [r["error"] for r in rows] == [None, None, "RuntimeError: no"]
    reports = spark.createDataFrame([("a", 1, 5.0, 0.95, 10), ("b", 2, 3.0, 0.93, 99)], "name string, cut int, time double, recall double, memory int")
    assert {(r.level, r.name) for r in tuning.best_configs(reports, "memory", 50).collect()} == {(x / 100, "a") for x in range(90, 95)}
