"""Reading and writing collections, queries, ranked lists, judgements and configurations."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import tomllib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.operators.ranking import global_rank

JSON_RECORD = "id string, content string, vector map<string,float>"
RUN = "query_id string, doc_id string, rank_no long, score double"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """id, content, vector of a .jsonl file, a .tar.gz with jsonl as its first entry, or a folder of jsonl files.

    Numeric ids become text; a line that can't be read is an error. Other suffixes are refused.
    """
    if path.endswith(".tar.gz"):
        return read_tar_gz(spark, path)
    if path.rstrip("/").rpartition("/")[2].count(".") and not path.endswith((".jsonl", ".jsonl.gz")):
        raise ValueError(f"neither .jsonl nor .tar.gz: {path}")
    return spark.read.schema(JSON_RECORD).json(path, mode="FAILFAST")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path).select("id", "vector")


def number(records: DataFrame, first: int = 1) -> DataFrame:
    """records with rec_no: numbers by id, then content, so that they are the same in each run."""
    ordered = global_rank(records.withColumn("__v", F.array_sort(F.map_entries("vector"))), ["id", "content", "__v"], "rec_no", first)
    return ordered.select(F.col("rec_no").cast("long").alias("rec_no"), "id", "content", "vector")


def _untar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for content in b["content"]:
            lines: list[str] = []
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                member = next((m for m in tar if m.isfile()), None)
                for raw in tar.extractfile(member) if member else ():
                    lines.append(raw.decode("utf-8"))
                    if len(lines) == 10_000:
                        yield pd.DataFrame({"line": lines})
                        lines = []
            yield pd.DataFrame({"line": lines})


def read_tar_gz(spark: SparkSession, path: str) -> DataFrame:
    """The records of the first file in each archive; archives are read one a task, lines in bounded portions."""
    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_untar, "line string").where(F.trim("line") != "")
    parsed = lines.select("line", F.from_json("line", JSON_RECORD, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def read_pretokenised(spark: SparkSession, path: str) -> DataFrame:
    """id, content, vector of files {"vectors": [{id, coordinates, values}]}; coordinates become tokens as text."""
    spec = "vectors array<struct<id:string,coordinates:array<string>,values:array<float>>>"
    rows = spark.read.schema(spec).json(path, multiLine=True, mode="FAILFAST").select(F.explode("vectors").alias("v"))
    return rows.select("v.id", F.lit(None).cast("string").alias("content"), F.map_from_arrays("v.coordinates", "v.values").alias("vector"))


def convert_queries(queries: DataFrame, tokens: DataFrame, strict: bool = False) -> DataFrame:
    """query_id, component, qw; unknown tokens are left out, or raise an error when strict."""
    long = queries.select(F.col("id").alias("query_id"), F.explode("vector").alias("token", "w"))
    from lexivane.operators.vectors import encode

    return encode(long, tokens, strict, "query_id").withColumnRenamed("w", "qw")


# inner binary form: u32 vectors, then for each u32 length, u32 components ascending, f32 values; little endian


def _read_inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0):
            data = raw.as_buffer()
            (n,) = struct.unpack_from("<I", data, 0)
            at, rows = 4, []
            for i in range(n):
                (size,) = struct.unpack_from("<I", data, at)
                components = np.frombuffer(data, "<u4", size, at + 4)
                rows.append({"ordinal": i, "components": components.astype(np.int64), "vals": np.frombuffer(data, "<f4", size, at + 4 + 4 * size)})
                at += 4 + 8 * size
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_pylist(rows, _INNER)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _INNER)


_INNER = pa.schema([("ordinal", pa.int64()), ("components", pa.list_(pa.int64())), ("vals", pa.list_(pa.float32()))])


def read_inner(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, components, vals of a binary vector file."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read_inner, "ordinal long, components array<long>, vals array<float>")


def write_inner(vectors: DataFrame, path: str, key: str = "rec_no") -> int:
    """Writes vectors (key, components ascending, vals) as one binary file in the order of key; returns how many.

    The form is one file with its length in front, so one process writes it, row by row.
    """
    n = 0
    with open(path, "wb") as f:
        f.write(struct.pack("<I", 0))
        for row in vectors.orderBy(key).toLocalIterator():
            f.write(struct.pack("<I", len(row.components)))
            f.write(np.asarray(row.components, "<u4").tobytes())
            f.write(np.asarray(row.vals, "<f4").tobytes())
            n += 1
        f.seek(0)
        f.write(struct.pack("<I", n))
    return n


# ranked lists and judgements


def write_run(hits: DataFrame, path: str, doc: str = "doc_id") -> None:
    """Tab-separated query, document, rank from 1 on, score, without a header."""
    hits.select("query_id", doc, "rank", "score").write.mode("overwrite").csv(path, sep="\t", header=False)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=RUN)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance. The second column is the useless one if it is constant; else the order is query, document, relevance, useless."""
    rows = spark.read.csv(path, sep="\t", schema="a string, b string, c string, d string")
    constant = rows.agg(F.count_distinct("b")).first()[0] <= 1
    doc, relevance = ("c", "d") if constant else ("b", "c")
    return rows.select(F.col("a").alias("query_id"), F.col(doc).alias("doc_id"), F.col(relevance).cast("long").alias("relevance"))


def write_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_toml(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def write_toml(config: dict, path: str) -> None:
    """Two levels: tables of scalars and lists."""

    def value(v: object) -> str:
        return json.dumps(v) if not isinstance(v, bool) else str(v).lower()

    with open(path, "w") as f:
        for k, v in config.items():
            if not isinstance(v, dict):
                f.write(f"{k} = {value(v)}\n")
        for k, v in config.items():
            if isinstance(v, dict):
                f.write(f"\n[{k}]\n" + "".join(f"{a} = {value(b)}\n" for a, b in v.items() if b is not None))


def write_maps(tokens: DataFrame, docs: DataFrame, path: str) -> None:
    tokens.write.mode("overwrite").parquet(f"{path}/token_map")
    docs.write.mode("overwrite").parquet(f"{path}/doc_map")
