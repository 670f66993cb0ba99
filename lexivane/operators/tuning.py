"""Grids of parameters, what is left of them to run, and the best configuration of each level of recall."""

from __future__ import annotations

import hashlib
import itertools
import json
import time
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def params_hash(params: Mapping[str, Any]) -> str:
    """Twelve characters that are the same for the same parameters in any order."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def combinations(grid: Mapping[str, Any], only_with: Mapping[str, tuple[str, Any]] | None = None) -> list[dict[str, Any]]:
    """Every combination of a grid (values that aren't lists stand for themselves), each once.

    only_with: for a parameter that matters only while another one has a certain value: (that one, the value). It is null otherwise.
    """
    names = list(grid)
    lists = [v if isinstance(v, (list, tuple)) else [v] for v in grid.values()]
    out: dict[str, dict[str, Any]] = {}
    for values in itertools.product(*lists):
        row = dict(zip(names, values))
        for name, (other, needed) in (only_with or {}).items():
            if row.get(other) != needed:
                row[name] = None
        out.setdefault(params_hash(row), row)
    return list(out.values())


def to_run(grid: Sequence[Mapping[str, Any]], reports: Mapping[str, int], expected: int) -> tuple[list[Mapping[str, Any]], list[str]]:
    """What isn't complete yet, and hashes of reports outside the grid. reports: rows by hash; complete from expected rows on."""
    by_hash = {params_hash(p): p for p in grid}
    return [p for h, p in by_hash.items() if reports.get(h, 0) < expected], sorted(set(reports) - set(by_hash))


def run_grid(grid: Sequence[Mapping[str, Any]], build: Callable[[Mapping[str, Any]], Any], queries: Mapping[str, Mapping[str, Any]], measure: Callable[[Any, Mapping[str, Any]], Mapping[str, Any]]) -> list[dict[str, Any]]:
    """A report row for each build and query configuration: parameters, build and query seconds, and what measure returns.

    A combination that fails gives a row with its error, and the others go on.
    """
    rows = []
    for params in grid:
        began = time.perf_counter()
        try:
            index = build(params)
            built = time.perf_counter() - began
            for name, knobs in queries.items():
                began = time.perf_counter()
                found = dict(measure(index, knobs))
                rows.append({"params": params_hash(params), "subsection": name, "build_s": built, "query_s": time.perf_counter() - began, **found, "error": None})
        except Exception as e:  # noqa: BLE001
            rows.append({"params": params_hash(params), "subsection": None, "build_s": None, "query_s": None, "error": f"{type(e).__name__}: {e}"[:200]})
    return rows


def best_configs(reports: DataFrame, memory: str = "memory", budget: float | None = None, lowest: int = 90, highest: int = 100) -> DataFrame:
    """level, name, cut, time: for each level of recall (in hundredths) the fastest report above it, within the memory budget.

    reports: name, cut, time, recall and the memory column. Ties go to the lower name, then cut. Levels no report exceeds have no row.
    """
    fit = reports if budget is None else reports.where(F.col(memory) <= budget)
    levels = reports.sparkSession.range(lowest, highest + 1).select((F.col("id") / 100).alias("level"))
    # a report counts for every level below its recall: a sequence of at most highest - lowest + 1 rows each
    own = fit.withColumn("level", F.explode(F.sequence(F.lit(lowest), F.lit(highest)))).withColumn("level", F.col("level") / 100).where(F.col("recall") > F.col("level"))
    order = F.struct("time", "name", "cut")
    best = own.groupBy("level").agg(F.min_by("name", order).alias("name"), F.min_by("cut", order).alias("cut"), F.min("time").alias("time"))
    return levels.join(best, "level")


def sample_reports(encoders: DataFrame) -> DataFrame:
    """Reports made up from the encoders table by a rule, to show best_configs on."""
    cut = F.explode(F.array(*[F.lit(c) for c in (1, 2, 4, 8, 12)]))
    rows = encoders.select("encoder_id", F.col("encoder_name").alias("name"), F.col("vocab_size").alias("memory"), cut.alias("cut"))
    recall = F.least(F.lit(0.999), F.lit(0.85) + F.lit(0.01) * F.col("cut") + F.lit(0.002) * F.col("encoder_id"))
    return rows.select("name", "cut", (F.lit(10.0) * F.col("cut") + F.col("encoder_id")).alias("time"), recall.alias("recall"), "memory")
