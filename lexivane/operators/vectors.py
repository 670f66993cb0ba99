"""Records and queries as long-form vectors: token map, encoding, statistics, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.operators.ranking import global_rank


def entries(records: DataFrame, key: str = "rec_no", vector: str = "vector") -> DataFrame:
    """key, token, w DOUBLE: a row for each entry of each vector with a weight. Null and empty vectors have no rows."""
    return records.select(key, F.explode(vector).alias("token", "value")).where(F.col("value").isNotNull()).select(key, "token", F.col("value").cast("double").alias("w"))


def token_map(long: DataFrame) -> DataFrame:
    """token, component INT: all distinct tokens, numbered from 0 in their order, so that the numbers can be reproduced."""
    distinct = long.select("token").where(F.col("token").isNotNull()).distinct()
    return global_rank(distinct, ["token"], "component", first=0).select("token", F.col("component").cast("int").alias("component"))


def encode(long: DataFrame, tokens: DataFrame, strict: bool = False, key: str = "rec_no") -> DataFrame:
    """key, component, w. Tokens that the map lacks are left out, or raise an error when strict."""
    if not strict:
        return long.join(tokens, "token").select(key, "component", "w")
    found = long.join(tokens, "token", "left")
    known = F.when(F.col("component").isNull(), F.raise_error(F.concat(F.lit("token without a component: "), F.col("token")))).otherwise(F.col("component"))
    return found.select(key, known.cast("int").alias("component"), "w")


def wide(forward: DataFrame, key: str = "rec_no") -> DataFrame:
    """key, components ARRAY<INT>, vals ARRAY<FLOAT>: stored form, components ascending."""
    pairs = F.array_sort(F.collect_list(F.struct("component", F.col("w").cast("float").alias("v"))))
    rows = forward.groupBy(key).agg(pairs.alias("p"))
    return rows.select(key, F.transform("p", lambda x: x["component"]).alias("components"), F.transform("p", lambda x: x["v"]).alias("vals"))


def get_vector(forward: DataFrame, rec_no: int) -> DataFrame:
    return wide(forward.where(F.col("rec_no") == rec_no))


def corpus_stats(records: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: len (records), dim (distinct tokens), nnz (entries), n_empty (records without entries)."""
    long = records.select(F.explode(vector).alias("token", "value")).where(F.col("value").isNotNull())
    inner = long.agg(F.count_distinct("token").alias("dim"), F.count(F.lit(1)).alias("nnz"))
    outer = records.agg(F.count(F.lit(1)).alias("len"), F.count_if(F.coalesce(F.size(vector), F.lit(0)) <= 0).alias("n_empty"))
    return outer.select("len", inner.select("dim").scalar().alias("dim"), inner.select("nnz").scalar().alias("nnz"), "n_empty")


def doc_map(records: DataFrame, content: bool = True) -> DataFrame:
    """rec_no, doc_id and, if asked for, content."""
    return records.select("rec_no", F.coalesce("id", F.col("rec_no").cast("string")).alias("doc_id"), *(["content"] if content else []))


def posting_lengths(forward: DataFrame) -> DataFrame:
    return forward.groupBy("component").agg(F.count(F.lit(1)).alias("n_postings"), F.max("w").alias("max_w"))


def mean_list_length(postings: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: the mean number of postings over all components, those without any included; 0 without components."""
    total = postings.agg(F.count(F.lit(1)).alias("n"))
    return tokens.agg(F.count(F.lit(1)).alias("dim")).select(F.coalesce(F.try_divide(total.scalar(), F.col("dim")), F.lit(0.0)).alias("mean_length"))
