"""Delivered record lines (jsonl and tsv) as cells: one (column, value, kind) for each value of a line."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CELLS_SCHEMA = "line_no long, cells array<struct<col:string,pos:int,value:string,kind:string>>"
_ARROW = pa.schema(
    [
        ("line_no", pa.int64()),
        ("cells", pa.list_(pa.struct([("col", pa.string()), ("pos", pa.int32()), ("value", pa.string()), ("kind", pa.string())]))),
    ]
)


class _Int(str):
    """An integer literal, as written."""


class _Num(str):
    """A literal with fraction or exponent, as written."""


def _refuse(name: str):
    raise ValueError(f"{name} isn't JSON")


_decode = json.JSONDecoder(parse_int=_Int, parse_float=_Num, parse_constant=_refuse, strict=True).decode


def _kind(v: object) -> str:
    if isinstance(v, _Int):
        return "integer"
    if isinstance(v, _Num):
        return "number"
    if v is None:
        return "null"
    return {str: "string", bool: "boolean", dict: "object", list: "array"}[type(v)]


def _text(v: object) -> str | None:
    if isinstance(v, str):
        return v.encode("utf-8", "replace").decode()
    return None if v is None else json.dumps(v)


def _vector_cells(v: object) -> list[tuple]:
    out = [("vector", 0, None, _kind(v))]
    if isinstance(v, dict):
        readable = {_text(token): weight for token, weight in v.items()}  # unpaired surrogates become one sign
        for i, (token, weight) in enumerate(readable.items()):
            out.append(("token", i, token, "string" if token else "empty"))
            out.append(("weight", i, _text(weight) if isinstance(weight, (_Int, _Num)) else None, _kind(weight)))
    return out


def jsonl_cells(line: str) -> list[tuple]:
    try:
        record = _decode(line)
    except (ValueError, RecursionError):
        record = None
    if type(record) is not dict:
        return [("line", 0, None, "broken")]
    out = [("line", 0, None, "parsed")]
    out += [("key", i, _text(k), "known" if k in ("id", "content", "vector") else "unknown") for i, k in enumerate(record)]
    out += [("key", len(record), k, "missing") for k in ("id", "vector") if k not in record]
    if "id" in record:
        out.append(("json_id", 0, _text(record["id"]), _kind(record["id"])))
    if "content" in record:
        out.append(("content", 0, _text(record["content"]), _kind(record["content"])))
    if "vector" in record:
        out += _vector_cells(record["vector"])
    return out


def tsv_fields(line: str) -> list[str] | None:
    """The fields of a line; None if its quoting is broken."""
    fields, at, n = [], 0, len(line)
    while True:
        if line.startswith('"', at):
            parts, at = [], at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return None
                parts.append(line[at:end])
                at = end + 1
                if not line.startswith('"', at):
                    break
                parts.append('"')
                at += 1
            fields.append("".join(parts))
            if at == n:
                return fields
            if line[at] != "\t":
                return None
            at += 1
        else:
            end = line.find("\t", at)
            if end < 0:
                fields.append(line[at:])
                return fields
            fields.append(line[at:end])
            at = end + 1


def tsv_cells(line: str) -> list[tuple]:
    fields = tsv_fields(line)
    if fields is None:
        return [("line", 0, None, "broken")]
    out = [("line", 0, None, "parsed"), ("fields", 0, str(len(fields)), "integer")]
    if len(fields) == 3:
        out += [("text_id", 0, fields[0], "string"), ("content", 0, fields[1], "string")]
        try:
            vector = _decode(fields[2])
        except (ValueError, RecursionError):
            return [*out, ("vector", 0, None, "broken")]
        out += _vector_cells(vector)
    return out


def line_cells(feed: str | None, line: str | None) -> list[tuple]:
    """Null lines, and lines of a feed that is neither jsonl nor tsv, are broken."""
    if line is None or feed not in ("jsonl", "tsv"):
        return [("line", 0, None, "broken")]
    return jsonl_cells(line) if feed == "jsonl" else tsv_cells(line)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        no, feed, line = (b.column(i).to_pylist() for i in range(3))
        cells = [[dict(zip(("col", "pos", "value", "kind"), c)) for c in line_cells(f, x)] for f, x in zip(feed, line)]
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(cells, _ARROW.field(1).type)], schema=_ARROW)


def parse_cells(lines: DataFrame) -> DataFrame:
    """line_no and the cells of each row of lines (line_no, feed, raw_line; other columns are ignored)."""
    return lines.select("line_no", "feed", "raw_line").mapInArrow(_parse, CELLS_SCHEMA)
