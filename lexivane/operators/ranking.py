"""Global ranks without a single task, and top-k by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane.session import cut

_LOW = (1 << 33) - 1


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank", first: int = 1) -> DataFrame:
    """df with the rank of each row in a total order, as row_number over the whole table would give.

    Rows are range-partitioned and sorted by order; a rank is the row's place in its partition plus the rows before it,
    for which one number a partition is summed up. Ties in order are ranked arbitrarily: add a unique column.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("__at", 33).cast("int")
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each partition
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn(name, F.col("before") + F.col("__at").bitwiseAND(F.lit(_LOW)) + F.lit(first))
        .drop("part", "before", "__at")
    )


def top_by(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int | Column, name: str = "rank") -> DataFrame:
    """The k first rows of each group in order, with their rank from 1 on."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
