"""Posting lists cut into blocks. postings: rec_no, component, w, pos (as the prune functions give them)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions.packed import Vectors, pack
from lexivane.operators.summaries import summed_up


def block_fixed(postings: DataFrame, block_size: int) -> DataFrame:
    """component, block, rec_no: blocks of block_size by pos; the last one takes the rest, and a list shorter than a
    block has none and is never searched."""
    length = F.count(F.lit(1)).over(Window.partitionBy("component"))
    sized = postings.withColumn("len", length).where(F.col("len") >= block_size)
    block = F.least(F.floor((F.col("pos") - 1) / block_size), F.floor(F.col("len") / block_size) - 1)
    return sized.select("component", block.cast("int").alias("block"), "rec_no")


def sample_order() -> Column:
    """The order in which records of a list are sampled as centroids: arithmetic, so that it can be reproduced anywhere."""
    return (F.col("rec_no") * F.lit(2654435761) + F.col("component").cast("long") * F.lit(40503)) % F.lit(1000003)


def centroids(postings: DataFrame, centroid_fraction: float) -> DataFrame:
    """component, centroid (a record), ord (from 1 on): max(1, trunc(centroid_fraction * length)) of each list, multiplied as FLOAT."""
    length = F.count(F.lit(1)).over(Window.partitionBy("component"))
    ord_ = F.row_number().over(Window.partitionBy("component").orderBy("h", "rec_no"))
    ranked = postings.select("component", "rec_no", sample_order().alias("h"), length.alias("len")).withColumn("ord", ord_)
    wanted = F.greatest(F.lit(1), F.floor((F.col("len").cast("float") * F.lit(centroid_fraction).cast("float")).cast("float")))
    return ranked.where(F.col("ord") <= wanted).select("component", F.col("rec_no").alias("centroid"), "ord")


#: Cells of a small product, which is made match by match, and records of a list that is clustered together with others in one task.
_SMALL, _SHORT = 4096, 256


def _assigned(whole: Vectors, center: np.ndarray, algorithm: str, min_cluster_size: int, doc_cut: int, pruning_factor: float, keep_dissolved: bool) -> tuple[np.ndarray, np.ndarray]:
    """The centroid, from 0 on, of each vector of a list, at first and after small clusters are dissolved (see clusters). center: the rows of the centroids."""
    last_wins = algorithm == "approx"

    def chosen(score: np.ndarray, live: np.ndarray, default: int) -> np.ndarray:
        """Of each row the best live column, from 0 on."""
        held = np.where(live[None, :], score, 0.0)
        best = held.shape[1] - 1 - held[:, ::-1].argmax(1) if last_wins else held.argmax(1)
        return np.where(held[np.arange(len(held)), best] > 0, best, default)

    middle = whole.take(center)
    n = len(center)
    docs = whole.heaviest(doc_cut) if last_wins else whole
    probe: Vectors | None = None
    if algorithm == "inverted":
        limit = max(5, int(np.float32(len(whole)) * np.float32(pruning_factor)))
        of = middle.rows()
        order = np.lexsort((of, -middle.values, middle.components))
        place = np.arange(len(of)) - np.searchsorted(middle.components[order], middle.components[order])
        keep = np.sort(order[place < limit])
        probe = Vectors(np.append(0, np.cumsum(np.bincount(of[keep], minlength=n))), middle.components[keep], middle.values[keep])

    def best(rows: np.ndarray, live: np.ndarray, default: int) -> np.ndarray:
        out = np.full(len(rows), default, np.int64)
        mine = docs.take(rows)
        if probe is None and len(rows) * n > _SMALL and live.any() and whole.finite():
            for part, score, error in mine.near(middle):
                score[:, ~live] = -np.inf
                row, col = np.nonzero(score >= (score.max(1) - np.float32(2.1 * error))[:, None])
                exact = mine.dots(row + part.start, middle, col)
                order = np.lexsort((-col if last_wins else col, -exact, row))
                order = order[np.diff(row, prepend=-1) != 0]  # row ascends, before and after it is ordered
                out[part] = np.where(exact[order] > 0, col[order], default)
            return out
        light = mine.heaviest(doc_cut) if probe is not None else mine
        for part, score in mine.products(middle):
            if probe is not None:
                some = light.take(np.arange(part.start, part.stop))
                score = np.where(np.concatenate([t for _, t in some.touches(probe)]), score, 0.0)
            out[part] = chosen(score, live, default)
        return out

    every = np.ones(n, bool)
    first = best(np.arange(len(whole)), every, n - 1 if last_wins else 0)
    if not last_wins:
        first[center] = np.arange(n)
    size = np.bincount(first, minlength=n)
    gone = (size <= min_cluster_size) & (size > 0)
    moving = np.flatnonzero(gone[first])
    final = first.copy()
    live = every if keep_dissolved else ~gone
    if len(moving):
        default = (int(np.flatnonzero(live)[-1]) if live.any() else 0) if last_wins else 0
        final[moving] = best(moving, live, default)
    return first, final


def clusters(
    postings: DataFrame,
    forward: DataFrame,
    cents: DataFrame,
    algorithm: str = "approx",
    min_cluster_size: int = 2,
    doc_cut: int = 15,
    pruning_factor: float = 0.005,
    keep_dissolved: bool = False,
) -> DataFrame:
    """component, rec_no, first, ord: the centroid each record of a list goes to at first, and after small clusters are dissolved.

    exact: whole inner products; a centroid goes to itself. inverted: whole inner products, but only with centroids found in
    one of the record's doc_cut heaviest components' centroid lists, cut to max(5, trunc(length * pruning_factor)); a centroid goes to itself.
    approx: inner products of the doc_cut heaviest components with whole centroids. Only scores above 0 count. Among equals the first
    centroid is taken, which is the default too; in approx the last one.
    The records of clusters with at most min_cluster_size of them then go to the best of the other centroids, those without
    any record included, or with keep_dissolved to the best of all centroids; with none left, to the first one.
    A pruned list is bounded, so one task clusters it as a whole, in matrices of a bounded number of cells.
    """
    if algorithm not in ("approx", "inverted", "exact"):
        raise ValueError(f"no such algorithm: {algorithm}")
    inside = postings.select("component", "rec_no").join(pack(forward, "rec_no"), "rec_no")
    marked = inside.join(cents.select("component", F.col("centroid").alias("rec_no"), F.col("ord").cast("int").alias("ord")), ["component", "rec_no"], "left")

    def run(table: pa.Table) -> pa.Table:
        ord_ = table["ord"].to_numpy(zero_copy_only=False)
        center = np.flatnonzero(~np.isnan(ord_.astype(np.float64)))
        first, final = _assigned(Vectors.of(table), center[np.argsort(ord_[center])], algorithm, min_cluster_size, doc_cut, pruning_factor, keep_dissolved)
        ids = {"component": table["component"], "rec_no": table["rec_no"]}
        return pa.table({**ids, "first": (first + 1).astype(np.int32), "ord": (final + 1).astype(np.int32)})

    return marked.groupBy("component").applyInArrow(run, "component int, rec_no long, first int, ord int")


def number_blocks(assigned: DataFrame) -> DataFrame:
    """component, block, rec_no: a block for each cluster that has records, in the order of their centroids' numbers."""
    block = F.dense_rank().over(Window.partitionBy("component").orderBy("ord")) - 1
    return assigned.select("component", block.cast("int").alias("block"), "rec_no")


def block_kmeans(
    postings: DataFrame, forward: DataFrame, centroid_fraction: float = 0.1, min_cluster_size: int = 2, algorithm: str = "approx", doc_cut: int = 15, pruning_factor: float = 0.005
) -> DataFrame:
    cents = centroids(postings, centroid_fraction)
    return number_blocks(clusters(postings, forward, cents, algorithm, min_cluster_size, doc_cut, pruning_factor))


def summarised_kmeans(
    postings: DataFrame,
    forward: DataFrame,
    centroid_fraction: float = 0.1,
    min_cluster_size: int = 2,
    algorithm: str = "approx",
    doc_cut: int = 15,
    pruning_factor: float = 0.005,
    energy: float | None = 0.4,
    n_components: int = 0,
) -> DataFrame:
    """component, block, rec_nos, c, code, low, step: the blocks of block_kmeans, a row each, with the summaries that quantise_summaries gives them
    (of summary_energy, or with energy None of summary_fixed). A list is clustered and summed up in one task, many short lists together in one,
    so that vectors are shuffled once and no entry of one by itself."""
    if algorithm not in ("approx", "inverted", "exact"):
        raise ValueError(f"no such algorithm: {algorithm}")
    length = F.count(F.lit(1)).over(Window.partitionBy("component"))
    place = F.row_number().over(Window.partitionBy("component").orderBy("h", "rec_no"))
    wanted = F.greatest(F.lit(1), F.floor((F.col("len").cast("float") * F.lit(centroid_fraction).cast("float")).cast("float")))
    ranked = postings.select("component", "rec_no", sample_order().alias("h"), length.alias("len")).withColumn("place", place)
    parts = 8 * int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = -1 - F.pmod(F.xxhash64("component"), F.lit(parts)).cast("int")
    marked = ranked.select(
        F.when(F.col("len") <= _SHORT, shared).otherwise(F.col("component")).alias("list"), "component", "rec_no", F.when(F.col("place") <= wanted, F.col("place")).otherwise(0).cast("int").alias("ord")
    )

    def run(table: pa.Table) -> pa.Table:
        of, ord_ = table["component"].to_numpy(), table["ord"].to_numpy()
        order = np.argsort(of, kind="stable")
        of, ord_ = of[order], ord_[order]
        ids, whole = table["rec_no"].to_numpy()[order], Vectors.of(table).take(order)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        ends = np.append(starts[1:], len(of))
        block = np.zeros(len(of), np.int64)
        for a, z in zip(starts, ends):
            center = np.flatnonzero(ord_[a:z])
            if len(center) > 1:
                center = center[np.argsort(ord_[a:z][center])]
                _, final = _assigned(whole.take(np.arange(a, z)), center, algorithm, min_cluster_size, doc_cut, pruning_factor, False)
                block[a:z] = np.unique(final, return_inverse=True)[1]
        order = np.lexsort((block, of))
        of, block, ids, whole = of[order], block[order], ids[order], whole.take(order)
        starts = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        sizes = np.diff(np.append(starts, len(of)))
        c, code, n, low, step = summed_up(np.repeat(np.arange(len(starts)), sizes), whole, energy, n_components)

        def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))

        return pa.table({"component": of[starts].astype(np.int32), "block": block[starts].astype(np.int32), "rec_nos": lists(ids, sizes), "c": lists(c, n), "code": lists(code, n), "low": low, "step": step})

    spec = "component int, block int, rec_nos array<long>, c array<int>, code array<short>, low double, step double"
    return marked.join(pack(forward, "rec_no"), "rec_no").groupBy("list").applyInArrow(run, spec)
