"""Aggregation of skewed keys by a tree of bounded fan-in, and the heavy posting lists built on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.functions.quantise import float_place, place_float
from lexivane.session import cut

_SLOT = "__tree_slot"
_ENTRY = ["entry_id", "rec_no", "token", "weight"]


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    leaf: Mapping[str, Column],
    merge: Mapping[str, Column],
    chunk: Column,
    n_chunks: int,
    fan_in: int = 16,
) -> DataFrame:
    """Aggregates df by keys so that no task receives more than fan_in states of a key at a time.

    chunk deals the rows to n_chunks input chunks (0 .. n_chunks - 1). The rows of a chunk are combined where they are (leaf), then
    the states of fan_in chunks with consecutive numbers meet (merge), then those of fan_in such groups, in as many
    rounds as it takes until one state a key is left: a key that owns a third of all rows costs its owner fan_in rows a round.
    leaf holds aggregates over the columns of df, merge aggregates over the columns that leaf made, under the same names.
    chunk should follow how df is partitioned (see chunks_of), else a chunk is combined in several places, and its parts meet in the
    first round. It must be a function of the row's values: a task that is run again then makes the same states.
    Null keys are a key of their own; an empty df gives an empty result.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    if set(leaf) != set(merge):
        raise ValueError("leaf and merge must name the same columns")
    left = -(-n_chunks // fan_in)
    # the first round's partial aggregation is the leaf: it runs in the tasks that hold the chunks
    slot = F.floor(chunk / F.lit(fan_in)) if left > 1 else F.lit(0)
    out = df.withColumn(_SLOT, slot.cast("long")).groupBy(*keys, _SLOT).agg(*[c.alias(k) for k, c in leaf.items()])
    while left > 1:
        left = -(-left // fan_in)
        up = F.floor(F.col(_SLOT) / F.lit(fan_in)) if left > 1 else F.lit(0)
        out = out.withColumn(_SLOT, up.cast("long")).groupBy(*keys, _SLOT).agg(*[c.alias(k) for k, c in merge.items()])
    return out.drop(_SLOT)


def chunks_of(df: DataFrame, by: Sequence[str], n_rows: int, chunk_rows: int) -> tuple[Column, int]:
    """The chunk of each row of df, and their number, for df shuffled on the columns by (by a groupBy on them, say) of n_rows rows.

    A chunk has some chunk_rows rows or fewer, all in one partition: the partition is told from the hash Spark deals rows by, and
    cut by another hash. Chunks with consecutive numbers lie in different partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a_part = max(1, -(-n_rows // (parts * chunk_rows)))
    part, piece = F.pmod(F.hash(*by), F.lit(parts)), F.pmod(F.xxhash64(*by), F.lit(a_part))
    return piece * F.lit(parts) + part, a_part * parts


def unique_entries(entries: DataFrame) -> DataFrame:
    """One row an entry, in its lowest batch. The rows of one entry_id differ at most in batch_no, so all other columns
    can be part of the key, which keeps the buffer a single number. Rows without entry_id count once by their other columns."""
    return entries.groupBy(*_ENTRY).agg(F.min("batch_no").alias("batch_no"))


def heavy_postings(entries: DataFrame, min_share: str = "0.02", fan_in: int = 16, chunk_rows: int = 1 << 17) -> DataFrame:
    """Of each batch, the tokens that hold at least min_share of its entries, with the best record of each.

    entries: entry_id, rec_no, token, weight, batch_no; other columns are ignored. A state is the number of entries and
    the largest weight with its lowest record, as one number, so that states are held by hash; they climb the tree of
    tree_aggregate from chunks of some chunk_rows entries.
    Returns batch_no, token, rec_no, weight, n_entries, batch_entries.
    Null or empty tokens count in their batch, but give no row. Null and NaN weights count in batch and token but
    are no best weight; rec_no is null if a token has no weight at all. Entries with a null rec_no count, but aren't
    the best record. Rows with a null batch_no make no batch. Ties go to the lowest rec_no.
    """
    share = Fraction(min_share)
    usable = F.col("weight").isNotNull() & ~F.isnan("weight") & F.col("rec_no").isNotNull()
    # place of the weight among all floats * 2^65 - rec_no: the largest is the largest weight, of the lowest record
    scale = F.lit(1 << 62).cast("decimal(20,0)") * F.lit(8).cast("decimal(1,0)")
    best = F.when(usable, (float_place(F.col("weight")).cast("decimal(11,0)") * scale - F.col("rec_no").cast("decimal(19,0)")).cast("decimal(38,0)"))
    unique = unique_entries(entries).where(F.col("batch_no").isNotNull())
    chunk, n_chunks = chunks_of(unique, _ENTRY, entries.count(), chunk_rows)
    states = tree_aggregate(
        unique.select("batch_no", "token", best.alias("top"), chunk.alias("chunk")),
        ["batch_no", "token"],
        {"n_entries": F.count(F.lit(1)), "best": F.max("top")},
        {"n_entries": F.sum("n_entries"), "best": F.max("best")},
        F.col("chunk"),
        n_chunks,
        fan_in,
    )
    lists = cut(states, "lists")  # read twice: the tree runs once
    totals = lists.groupBy("batch_no").agg(F.sum("n_entries").alias("batch_entries"))
    place = F.round(F.col("best") / scale)  # rec_no is at most a quarter of the scale
    whole = place.cast("decimal(11,0)")
    return (
        lists.where(F.col("token") != "")
        .join(totals, "batch_no")
        .where(F.col("n_entries") * share.denominator >= F.col("batch_entries") * share.numerator)
        .select(
            "batch_no",
            "token",
            (whole * scale - F.col("best")).cast("long").alias("rec_no"),
            place_float(whole.cast("long")).alias("weight"),
            "n_entries",
            "batch_entries",
        )
    )
