"""The graph of each record's nearest other records. graph: rec_no, rank (from 1 on), neighbour, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.operators import search
from lexivane.operators.ranking import top_by


def as_queries(forward: DataFrame) -> DataFrame:
    return forward.select(F.col("rec_no").alias("query_id"), "component", F.col("w").alias("qw"))


def knn_graph(forward: DataFrame, blocks: DataFrame, codes: DataFrame, dim: int, cut: int = 10, heap_factor: float = 0.7) -> DataFrame:
    """dim neighbours of each record by self-search, the record itself left out: a record's own vector as the query, blocks skipped
    by their summaries (see search.pruned_topk). A record with fewer neighbours has fewer rows."""
    hits = search.pruned_topk(as_queries(forward), search.lists_of(blocks, forward, codes), dim + 1, cut, heap_factor, False)
    return _graph(hits, dim)


def candidate_graph(forward: DataFrame, postings: DataFrame, dim: int, cut: int = 10) -> DataFrame:
    """As knn_graph, of all candidates of the cut heaviest components."""
    return _graph(search.candidate_topk(as_queries(forward), postings, forward, dim + 1, cut), dim)


def _graph(hits: DataFrame, dim: int) -> DataFrame:
    others = hits.where(F.col("query_id") != F.col("rec_no")).select(F.col("query_id").alias("rec_no"), F.col("rec_no").alias("neighbour"), "score")
    return top_by(others, ["rec_no"], [F.desc("score"), "neighbour"], dim).select("rec_no", "rank", "neighbour", "score")


def limit_graph(graph: DataFrame, limit: int) -> DataFrame:
    """The first limit neighbours of each record; limit must not exceed what is stored."""
    stored = graph.agg(F.max("rank")).first()[0] or 0
    if limit > stored:
        raise ValueError(f"limit {limit} exceeds the {stored} neighbours stored")
    return graph.where(F.col("rank") <= limit)


def knn_len(graph: DataFrame | None) -> int:
    return 0 if graph is None else (graph.agg(F.max("rank")).first()[0] or 0)
