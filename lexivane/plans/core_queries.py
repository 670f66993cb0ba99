"""The registered queries of the core's data preparation and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexivane.operators import tree, validate
from lexivane.session import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.heavy_postings(table(spark, sf_dir, "vector_entries")).select("batch_no", "token", "rec_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.failed_lines(spread(table(spark, sf_dir, "raw_lines")))


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.loaded_lines(spread(table(spark, sf_dir, "raw_lines")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p5_found, p5_loaded)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
with e as (
  select entry_id, rec_no, token, weight, min(batch_no) batch_no from vector_entries group by all
), totals as (
  select batch_no, count(*) n from e group by batch_no
), lists as (
  select batch_no, token, count(*) n, max(weight) best from e where token <> '' group by batch_no, token
)
select l.batch_no, l.token, (
    select min(rec_no) from e where e.batch_no = l.batch_no and e.token = l.token and e.weight = l.best
  ) rec_no
from lists l join totals t on t.batch_no = l.batch_no where l.n * 50 >= t.n
"""
    }
