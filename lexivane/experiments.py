"""Experiments: build an index, search with several settings, score the results, report; grids of such, with resume.

A configuration has the sections data (documents, queries, truth and qrels as paths, the last two optional), indexing
(parameters of the index), and query, a table of settings by name. Lists in indexing stand for a sweep.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.config import Configuration
from lexivane.index import SparseIndex
from lexivane.operators import metrics, search, tuning, vectors
from lexivane.sources import records as sources

REPORT = "params string, subsection string, query_us double, recall double, mrr double, ndcg double, map double, memory long, build_s double, n_queries long, n_short long, error string"
#: The section of the configuration that each parameter of indexing belongs to.
SECTIONS = {
    "pruned": {"kind": "pruning", "n_postings": "n_postings", "max_fraction": "max_fraction", "alpha": "alpha"},
    "blocked": {
        "kind": "blocking", "block_size": "block_size", "centroid_fraction": "centroid_fraction", "min_cluster_size": "min_cluster_size",
        "algorithm": "clustering", "doc_cut": "doc_cut", "pruning_factor": "pruning_factor",
    },
    "summarized": {"kind": "summary", "n_components": "n_components", "energy": "summary_energy"},
    "with_knn": {"nknn": "knn", "knn_path": "knn_path"},
}
#: Parameters that matter only with a certain value of another one.
ONLY_WITH = {
    "max_fraction": ("pruning", "global"), "alpha": ("pruning", "coi"), "block_size": ("blocking", "fixed"), "centroid_fraction": ("blocking", "kmeans"),
    "min_cluster_size": ("blocking", "kmeans"), "clustering": ("blocking", "kmeans"), "summary_energy": ("summary", "energy"), "n_components": ("summary", "fixed"),
}


def configuration(params: Mapping[str, Any]) -> Configuration:
    known = {p for names in SECTIONS.values() for p in names.values()} | {"value_type"}
    if unknown := set(params) - known:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    config = Configuration().with_value_type(params.get("value_type") or "f16")
    for method, names in SECTIONS.items():
        config = getattr(config, method)(**{field: params[p] for field, p in names.items() if params.get(p) is not None})
    return config


def run_experiment(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """A report row for each setting in query; REPORT is its schema. Without truth, exact search gives it; without qrels, measures are 0."""
    data, params = config["data"], dict(config.get("indexing", {}))
    name = tuning.params_hash(params)
    began = time.perf_counter()
    records = sources.number(sources.read_records(spark, data["documents"]))
    index = SparseIndex.from_records(records, configuration(params))
    built = time.perf_counter() - began
    queries = sources.read_records(spark, data["queries"])
    memory = index.space_usage().agg(F.sum("n_bytes")).first()[0]
    qrels = metrics.clean_qrels(sources.read_qrels(spark, data["qrels"])) if data.get("qrels") else None
    rows = []
    for setting, knobs in config["query"].items():
        k = knobs.get("k", 10)
        began = time.perf_counter()
        hits = index.search_tokens(queries, k, knobs["query_cut"], knobs["heap_factor"], knobs.get("n_knn", 0), knobs.get("first_sorted", False)).cache()
        n = queries.count()
        hits.count()
        query_us = (time.perf_counter() - began) * 1e6 / max(n, 1)
        if data.get("truth"):
            truth = sources.read_run(spark, data["truth"]).withColumnRenamed("rank_no", "rank")
        else:
            truth = search.remap(search.exact_topk(records, queries, k), vectors.doc_map(records, False))
        recall = metrics.accuracy_at_k(hits, truth, k).first().accuracy
        quality = metrics.summary(hits, qrels, k).first() if qrels is not None else None
        short = metrics.short_results(hits, queries, k).count()
        scores = [quality[m] if quality else 0.0 for m in ("mrr", "ndcg", "map")]
        rows.append((name, setting, query_us, recall, *scores, memory, built, n, short, None))
        hits.unpersist()
    return spark.createDataFrame(rows, REPORT)


def run_grid_search(spark: SparkSession, config: Mapping[str, Any], out: str) -> DataFrame:
    """Runs every combination of indexing that has no complete report below out yet, and returns all reports.

    A combination that fails is reported with its error, and isn't complete. Reports outside the grid are left alone.
    """
    grid = tuning.combinations(config.get("indexing", {}), {k: v for k, v in ONLY_WITH.items() if v[0] in config.get("indexing", {})})
    os.makedirs(out, exist_ok=True)
    done = {f.removesuffix(".report"): len(json.load(open(f"{out}/{f}"))) for f in os.listdir(out) if f.endswith(".report")}
    left, _ = tuning.to_run(grid, done, len(config["query"]))
    for params in left:
        used = {k: v for k, v in params.items() if v is not None}
        try:
            rows = [r.asDict() for r in run_experiment(spark, {**config, "indexing": used}).collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{tuning.params_hash(params)} failed: {type(e).__name__}: {e}"[:300])
            continue
        name = tuning.params_hash(params)
        with open(f"{out}/{name}.report", "w") as f:
            json.dump([{**r, "params": name, "indexing": used} for r in rows], f)
    return collect_reports(spark, out)


def collect_reports(spark: SparkSession, out: str) -> DataFrame:
    """All report rows below out, with name (of the combination), cut (the setting's place) and time, as best_configs takes them."""
    rows = []
    for f in sorted(os.listdir(out)):
        if f.endswith(".report"):
            for i, r in enumerate(json.load(open(f"{out}/{f}"))):
                rows.append((r["params"], i, r["query_us"], r["recall"], r["memory"], r["subsection"], json.dumps(r["indexing"])))
    return spark.createDataFrame(rows, "name string, cut int, time double, recall double, memory long, subsection string, indexing string")


def write_best(reports: DataFrame, config: Mapping[str, Any], out: str, budget: float | None = None) -> list[str]:
    """A TOML file recall_<level>.toml below out for each level of recall that a report exceeds; their paths."""
    best = tuning.best_configs(reports, "memory", budget).join(reports.select("name", "cut", "subsection", "indexing"), ["name", "cut"])
    paths = []
    os.makedirs(out, exist_ok=True)
    for r in best.orderBy("level").collect():  # at most a row for each level
        path = f"{out}/recall_{round(r.level * 100)}.toml"
        sources.write_toml({"indexing": json.loads(r.indexing), f"query.{r.subsection}": dict(config["query"][r.subsection])}, path)
        paths.append(path)
    return paths
