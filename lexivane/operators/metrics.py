"""Quality of ranked lists. run: query_id, doc_id, rank; truth: the same; qrels: query_id, doc_id, relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_qrels(qrels: DataFrame) -> DataFrame:
    """One judgement for each query and document; of contradicting ones the highest."""
    return qrels.where(F.col("query_id").isNotNull() & F.col("doc_id").isNotNull()).groupBy("query_id", "doc_id").agg(F.max(F.coalesce("relevance", F.lit(0))).alias("relevance"))


def clean_run(run: DataFrame) -> DataFrame:
    """query_id, doc_id, rank: each document once a query, at its best place, places numbered anew from 1 on."""
    best = run.groupBy("query_id", "doc_id").agg(F.min("rank_no").alias("place"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "doc_id"))).drop("place")


def accuracy_at_k(run: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row: the share of the truth's rows (rank up to k) that the run has among its k best; a query that the run lacks counts 0."""
    want = truth.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    have = run.where(F.col("rank") <= k).select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    joined = want.join(have, ["query_id", "doc_id"], "left")
    return joined.agg(F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(0.0)).alias("accuracy"), F.count("hit").alias("n_hits"), F.count(F.lit(1)).alias("n_truth"))


def judged(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return run.where(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def by_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rr, ndcg, ap of each query with a relevant document in qrels; those that the run lacks have 0.

    rr: 1 / rank of the first relevant document up to k. ndcg: gains relevance / log2(rank + 1) up to k over those of the best
    order. ap: the mean precision at relevant documents, over all ranks of the run.
    """
    wanted = qrels.where(F.col("relevance") > 0)
    all_ranks = run.join(wanted, ["query_id", "doc_id"])
    seen = all_ranks.withColumn("found", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    near = F.col("rank") <= k
    got = seen.groupBy("query_id").agg(
        F.min(F.when(near, F.col("rank"))).alias("first"),
        F.sum(F.when(near, F.col("relevance") / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.sum(F.col("found") / F.col("rank")).alias("precisions"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    ideal = (
        wanted.withColumn("place", place)
        .groupBy("query_id")
        .agg(F.sum(F.when(F.col("place") <= k, F.col("relevance") / F.log2(F.col("place") + 1))).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    return ideal.join(got, "query_id", "left").select(
        "query_id",
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce(F.col("dcg") / F.col("best"), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.col("precisions") / F.col("n"), F.lit(0.0)).alias("ap"),
    )


def summary(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row: the means over queries, and their number; 0 without any."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for c, name in (("rr", "mrr"), ("ndcg", "ndcg"), ("ap", "map"))]
    return by_query(run, qrels, k).agg(*means, F.count(F.lit(1)).alias("n_queries"))


def short_results(run: DataFrame, queries: DataFrame, k: int, query_key: str = "id") -> DataFrame:
    """query_id, n: queries with fewer than k results, and how many they have."""
    have = run.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.select(F.col(query_key).alias("query_id"))
    return asked.join(have, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
