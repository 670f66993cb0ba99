"""Which entries a posting list keeps. forward: rec_no, component, w."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.operators.ranking import global_rank, top_by
from lexivane.session import cut


def prune_fixed(forward: DataFrame, n_postings: int) -> DataFrame:
    """The n_postings heaviest entries of each list; pos from 1 on, by weight descending, then record."""
    return top_by(forward, ["component"], [F.desc("w"), "rec_no"], n_postings, "pos")


def prune_global(forward: DataFrame, n_postings: int, max_fraction: float = 1.5, dim: int | None = None) -> DataFrame:
    """Of the dim * n_postings heaviest entries of the whole collection, at most trunc(n_postings * max_fraction) a list.

    Entries that find their list full aren't replaced by lighter ones of other lists. dim: the number of components.
    """
    if dim is None:
        dim = forward.agg(F.count_distinct("component")).first()[0]
    wanted, most = dim * n_postings, int(n_postings * max_fraction)
    # an entry behind place most of its list can't be kept, but counts among the heaviest: the weight at the last place is found
    # from the number of entries a weight, and only the entries tied at it are put in order
    counts = cut(forward.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "weights")
    bound = weight_at(counts, wanted)
    if bound is None:
        return top_by(forward, ["component"], [F.desc("w"), "rec_no"], most, "pos")
    weight, left = bound
    above = forward.where(F.col("w") > F.lit(weight))
    tied = global_rank(forward.where(F.col("w") == F.lit(weight)), ["component", "rec_no"], "place").where(F.col("place") <= left).drop("place")
    return top_by(above.unionByName(tied.select(*above.columns)), ["component"], [F.desc("w"), "rec_no"], most, "pos")


def weight_at(counts: DataFrame, place: int) -> tuple[float, int] | None:
    """The weight at a place, from 1 on, of all entries by weight descending, and how many entries of that weight are up to it; None
    if there are no more than place entries. counts: w and n, a row a weight. The range of weights is cut to 1,000 in each round, so a few
    rounds over counts tell, and only sums by range come to the driver."""
    low, high, total = counts.agg(F.min("w"), F.max("w"), F.sum("n")).first()
    if total is None or total <= place:
        return None
    before = 0
    while low < high:
        step = (high - low) / 1000  # different weights fall apart in the end: a round ends at weights that are there
        slot = F.floor((F.lit(high) - F.col("w")) / F.lit(step)).cast("long")
        inside = counts.where((F.col("w") >= F.lit(low)) & (F.col("w") <= F.lit(high)))
        for _, n, least, most in sorted(inside.groupBy(slot.alias("slot")).agg(F.sum("n"), F.min("w"), F.max("w")).collect()):
            if before + n >= place:
                low, high = least, most
                break
            before += n
    return low, place - before


def prune_coi(forward: DataFrame, alpha: float, n_postings: int) -> DataFrame:
    """Of each list the share alpha of its length, one more, and at most n_postings."""
    lengths = forward.groupBy("component").agg(F.count(F.lit(1)).alias("len"))
    top = top_by(forward, ["component"], [F.desc("w"), "rec_no"], n_postings, "pos")  # a fixed limit: a long list is cut before it is shuffled
    return top.join(lengths, "component").where(F.col("pos") <= F.floor(F.col("len") * F.lit(alpha)) + 1).select(*forward.columns, "pos")
