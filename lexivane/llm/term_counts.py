"""Occurrences and records of every term by last-seen counters."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_counts(entries: DataFrame, salts: int | None = None) -> DataFrame:
    """token, n_entries, n_records of every token of entries (entry_id, rec_no, token; other columns are ignored).

    Entries are hash-partitioned by token and a salt of the record, and ordered by record and entry. A counter of a
    term then only needs the record and the entry it saw last: another record adds a record and an entry, another
    entry an entry, a repeated row nothing. No set of records is held. A salt has records of its own, so
    the counters of a token's salts add up; a token with a third of all rows is spread over as many tasks.
    salts: twice the session's shuffle partitions, if not given, so that the parts of one token reach every task.
    Null and empty tokens are terms here; a null record counts in n_entries only; null entry_ids of a record are one entry.
    """
    salts = salts or 2 * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = entries.select("token", "rec_no", "entry_id", F.pmod(F.xxhash64("rec_no"), F.lit(salts)).cast("int").alias("salt"))
    w = Window.partitionBy("token", "salt").orderBy("rec_no", "entry_id")
    seen = salted.select(
        "token",
        "salt",
        "rec_no",
        "entry_id",
        F.lag("rec_no").over(w).alias("last_rec"),
        F.lag("entry_id").over(w).alias("last_entry"),
        F.lag(F.lit(True), 1, False).over(w).alias("any"),
    )
    new_record = ~F.col("any") | ~F.col("rec_no").eqNullSafe(F.col("last_rec"))
    new_entry = new_record | ~F.col("entry_id").eqNullSafe(F.col("last_entry"))
    return (
        seen.groupBy("token", "salt")
        .agg(F.count_if(new_entry).alias("n_entries"), F.count_if(new_record & F.col("rec_no").isNotNull()).alias("n_records"))
        .groupBy("token")
        .agg(F.sum("n_entries").alias("n_entries"), F.sum("n_records").alias("n_records"))
    )


def mark_terms(entries: DataFrame, rare_at_most: int = 2, common_above: str = "0.25", salts: int | None = None) -> DataFrame:
    """term_counts with mark: rare, common or null, and the number of all records.

    rare: in at most rare_at_most records; common: in more than the share common_above of all distinct records of
    entries, rows with a null token included. A token that is both, as in a tiny table, is rare.
    Null and empty tokens are counted but get no mark. An empty table gives no row.
    """
    share = Fraction(common_above)
    total = entries.agg(F.count_distinct("rec_no").alias("all_records"))
    counts = term_counts(entries, salts)
    named = F.col("token").isNotNull() & (F.col("token") != "")
    return counts.select("*", total.scalar().alias("all_records")).withColumn(
        "mark",
        F.when(named & (F.col("n_records") <= rare_at_most), "rare").when(
            named & (F.col("n_records") * share.denominator > F.col("all_records") * share.numerator), "common"
        ),
    )
