"""Lines that can't be loaded, with the reason, and the others as loaded records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.session import cut
from lexivane.sources.raw_lines import parse_cells

ID_PATTERN = r"\A[A-Za-z0-9][A-Za-z0-9_:\-]*\z"

#: Reasons in the order in which they apply, and the reason a column's cells fail for.
REASONS = ["syntax", "fields", "id", "vector"]
COLUMN_REASON = {"line": "syntax", "key": "fields", "fields": "fields", "json_id": "id", "text_id": "id", "vector": "vector", "token": "vector", "weight": "vector"}

#: Column, kind, pattern, lowest and highest value of what is allowed. A cell of a kind without a row here fails.
RULES = [
    ("line", "parsed", None, None, None),
    ("key", "known", None, None, None),
    ("fields", "integer", None, "3", "3"),
    ("json_id", "integer", None, "0", "9223372036854775807"),
    ("json_id", "string", ID_PATTERN, None, None),
    ("text_id", "string", ID_PATTERN, None, None),
    ("vector", "object", None, None, None),
    ("token", "string", None, None, None),
    ("weight", "integer", None, "0", "3.4028235e38"),
    ("weight", "number", None, "0", "3.4028235e38"),
]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "col string, kind string, pattern string, lowest string, highest string")


def failures(cells: DataFrame) -> DataFrame:
    """line_no, reason, n_errors of each line with a failing cell; cells as parse_cells gives them.

    The rule table has a row for each allowed (column, kind): its size is fixed, so it is broadcast. Only failing cells
    are shuffled. Integers outside 38 digits compare as doubles, which decides the same for the bounds in use.
    """
    spark = cells.sparkSession
    columns = F.create_map(*[F.lit(x) for kv in COLUMN_REASON.items() for x in kv])
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(REASONS) for x in (r, i)])
    cell = cells.select("line_no", F.explode("cells").alias("c")).select("line_no", "c.*").where(F.col("col") != "content")
    joined = cell.join(F.broadcast(rule_table(spark).withColumn("ruled", F.lit(True))), ["col", "kind"], "left")

    def number(c: str, as_type: str):
        return F.col(c).try_cast(as_type)

    exact = number("value", "decimal(38,0)")
    bounded = F.when(
        F.col("kind") == "integer",
        F.coalesce(
            F.when(exact.isNotNull() & number("highest", "decimal(38,0)").isNotNull(), (exact >= number("lowest", "decimal(38,0)")) & (exact <= number("highest", "decimal(38,0)"))),
            (number("value", "double") >= number("lowest", "double")) & (number("value", "double") <= number("highest", "double")) & ~((F.col("col") == "json_id") & exact.isNull()),
        ),
    ).otherwise((number("value", "double") >= number("lowest", "double")) & (number("value", "double") <= number("highest", "double")))
    passes = (
        F.col("ruled").isNotNull()
        & (F.col("pattern").isNull() | F.expr("coalesce(value rlike pattern, false)"))
        & (F.col("lowest").isNull() | F.coalesce(bounded, F.lit(False)))
    )
    failed = joined.where(~passes).select("line_no", F.element_at(ranks, F.element_at(columns, F.col("col"))).alias("rank"))
    return (
        failed.groupBy("line_no")
        .agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n_errors"))
        .select("line_no", F.element_at(F.array(*map(F.lit, REASONS)), F.col("rank") + 1).alias("reason"), "n_errors")
    )


def failed_lines(lines: DataFrame) -> DataFrame:
    """line_no and reason of each line that can't be loaded. lines: line_no, feed, raw_line; other columns are ignored.

    Null lines and unknown feeds fail for syntax. Of a repeated key the last value holds. A line nested too
    deeply for the parser fails as one that isn't JSON. line_no must be unique; repeated lines are lines of their own.
    """
    return failures(parse_cells(lines)).select("line_no", "reason")


def loaded_lines(lines: DataFrame) -> DataFrame:
    """line_no, id, content, vector of each line without a failing cell: the parsed lines anti-joined with the failures.

    content that isn't a string is kept as its JSON text, an absent or null one is null; weights are rounded to FLOAT.
    """
    cells = cut(parse_cells(lines), "cells")  # read twice: a line is parsed once

    def values(col: str):
        return F.transform(F.filter("cells", lambda c: c["col"] == col), lambda c: c["value"])

    weights = F.transform(values("weight"), lambda v: v.cast("double").cast("float"))
    return (
        cells.join(failures(cells).select("line_no"), "line_no", "left_anti")
        .select(
            "line_no",
            F.get(F.transform(F.filter("cells", lambda c: c["col"].isin("json_id", "text_id")), lambda c: c["value"]), F.lit(0)).alias("id"),
            F.get(values("content"), F.lit(0)).alias("content"),
            F.map_from_arrays(values("token"), weights).alias("vector"),
        )
    )
