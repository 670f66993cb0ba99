"""What a block's vectors can reach at most, cut short and in 8 bits. blocks: component, block, rec_no."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions.packed import Vectors
from lexivane.operators.ranking import top_by

_BLOCK = ["component", "block"]


def block_max(blocks: DataFrame, forward: DataFrame) -> DataFrame:
    """component, block, c, w: the largest weight of each component c over the whole vectors of the block's records."""
    whole = forward.select("rec_no", F.col("component").alias("c"), "w")
    return blocks.join(whole, "rec_no").groupBy(*_BLOCK, "c").agg(F.max("w").alias("w"))


def summary_fixed(maxima: DataFrame, n_components: int) -> DataFrame:
    """The n_components largest maxima of each block."""
    return top_by(maxima, _BLOCK, [F.desc("w"), "c"], n_components, "r").drop("r")


def summary_energy(maxima: DataFrame, energy: float = 0.4) -> DataFrame:
    """The largest maxima of each block, up to and with the one at which their sum first reaches the share energy of the whole."""
    by = Window.partitionBy(*_BLOCK)
    before = F.sum("w").over(by.orderBy(F.desc("w"), "c").rowsBetween(Window.unboundedPreceding, -1))
    summed = maxima.withColumn("before", F.coalesce(before, F.lit(0.0))).withColumn("total", F.sum("w").over(by))
    return summed.where((F.col("before") == 0) | (F.col("before") < F.col("total") * F.lit(energy))).drop("before", "total")


def quantise_summaries(summaries: DataFrame) -> DataFrame:
    """component, block, c, code SHORT, low, step: w is about low + code * step; 255 steps from the least to the largest.
    A block whose maxima are all equal has step 0 and codes 0."""
    by = Window.partitionBy(*_BLOCK)
    bounded = summaries.withColumn("low", F.min("w").over(by)).withColumn("step", (F.max("w").over(by) - F.min("w").over(by)) / F.lit(255.0))
    code = F.coalesce(F.round(F.try_divide(F.col("w") - F.col("low"), F.col("step"))), F.lit(0.0))
    return bounded.select(*_BLOCK, "c", code.cast("short").alias("code"), "low", "step")


def _running(w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the sum of those before it in its group, added one after the other, and the sum of each group. sizes: entries of the groups, 1 at least."""
    before, total = np.zeros(len(w)), np.zeros(len(sizes))
    starts, kind = np.cumsum(sizes) - sizes, np.ceil(np.log2(sizes))
    for x in np.unique(kind):
        groups = np.flatnonzero(kind == x)
        at = np.arange(sizes[groups].max())
        inside = at < sizes[groups][:, None]
        where = (starts[groups][:, None] + at)[inside]
        sums = np.zeros((len(groups), len(at) + 1))
        sums[:, 1:][inside] = w[where]
        sums = np.cumsum(sums, axis=1)
        before[where], total[groups] = sums[:, :-1][inside], sums[:, -1]
    return before, total


def summed_up(of: np.ndarray, d: Vectors, energy: float | None, n_components: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """c and code of blocks, one's after the other's, how many each has, low and step: what quantise_summaries gives of summary_energy, or with
    energy None of summary_fixed, of block_max. of: the block, ascending from 0 on, of each vector."""
    of = np.repeat(of, np.diff(d.starts))
    keys = of << 32 | d.components
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    of, c = keys[starts] >> 32, (keys[starts] & 0xFFFFFFFF).astype(np.int32)
    w = np.maximum.reduceat(d.values[order], starts) if len(starts) else np.zeros(0)
    order = np.lexsort((-w, of))  # c ascends among equals
    c, w, sizes = c[order], w[order], np.bincount(of)
    before, total = _running(w, sizes)
    if energy is None:
        keep = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < n_components
    else:
        keep = (before == 0) | (before < np.repeat(total, sizes) * energy)
    of, c, w = of[keep], c[keep], w[keep]
    sizes = np.bincount(of, minlength=len(sizes))
    some = sizes > 0
    low, high = np.zeros(len(sizes)), np.zeros(len(sizes))
    if len(w):
        low[some], high[some] = (f.reduceat(w, (np.cumsum(sizes) - sizes)[some]) for f in (np.minimum, np.maximum))
    step = (high - low) / 255.0
    with np.errstate(divide="ignore", invalid="ignore"):
        code = np.where(step[of] > 0, np.floor((w - low[of]) / step[of] + 0.5), 0.0)
    return c, code.astype(np.int16), sizes, low, step


def block_estimates(cut_queries: DataFrame, queries: DataFrame, blocks: DataFrame, codes: DataFrame) -> DataFrame:
    """query_id, list_rank, component, block, est: of every block of the lists that a query visits, the inner product of the whole
    query with the block's summary; 0 if they share nothing. cut_queries: query_id, component, list_rank; queries: query_id, component, qw."""
    visited = cut_queries.join(blocks.select(*_BLOCK).distinct(), "component")
    dequantised = codes.select(*_BLOCK, "c", (F.col("low") + F.col("code") * F.col("step")).alias("v"))
    shared = (
        visited.select("query_id", *_BLOCK)
        .join(dequantised, _BLOCK)
        .join(queries.select("query_id", F.col("component").alias("c"), "qw"), ["query_id", "c"])
        .groupBy("query_id", *_BLOCK)
        .agg(F.sum(F.col("qw") * F.col("v")).alias("est"))
    )
    return visited.join(shared, ["query_id", *_BLOCK], "left").select("query_id", "list_rank", *_BLOCK, F.coalesce("est", F.lit(0.0)).alias("est"))
