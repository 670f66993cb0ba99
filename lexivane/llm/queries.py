"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.llm import hilbert_knn, mojibake, odd_sketch, packing, term_counts, trie_bpe
from lexivane.session import spread, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.mark_terms(table(spark, sf_dir, "vector_entries")).where("mark is not null").select("token", "mark")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.mark_terms(table(spark, sf_dir, "vector_entries")).select("token", "n_entries", "n_records", "mark")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_knn.partner_pairs(hilbert_knn.best_partners(spread(table(spark, sf_dir, "sparse_records"))))


def _sampled_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All records, and the stated query set: those whose number is divisible by 50."""
    records = spread(table(spark, sf_dir, "sparse_records"))
    return records, records.where(F.col("rec_no") % 50 == 0)


def p3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact lists of the query set, against all records."""
    return hilbert_knn.exact_partners(*_sampled_records(spark, sf_dir))


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the exact lists of the query set p3's lists hold."""
    records, wanted = _sampled_records(spark, sf_dir)
    return hilbert_knn.recall(hilbert_knn.best_partners(records), hilbert_knn.exact_partners(records, wanted))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spread(table(spark, sf_dir, "sparse_records"))
    found = odd_sketch.near_duplicates(records, "rec_no", "content", threshold=0.6, width=3, least_words=8)
    return odd_sketch.record_pairs(*found, "rec_no")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_texts(spread(table(spark, sf_dir, "documents")))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = trie_bpe.encode_texts(spread(table(spark, sf_dir, "documents")), ids=False)
    return packing.pack(sizes.withColumnRenamed("n_tokens", "size"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(spread(table(spark, sf_dir, "documents"))).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(spread(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_exact, p3_recall, p4_found, p6_ids, p7_pack, p8_found, p8_restored)}


_P2 = """
with counted as (
  select token, cast(count(distinct coalesce(entry_id, -1)) as bigint) n_entries, cast(count(distinct rec_no) as bigint) n_records
  from vector_entries group by token
), total as (select count(distinct rec_no) n from vector_entries)
select token, {cols} case when token <> '' and n_records <= 2 then 'rare'
  when token <> '' and n_records * 4 > (select n from total) then 'common' end mark
from counted
"""


_P3 = """
with e as (
  select rec_no, x.key token, cast(x.value as double) w from (select rec_no, unnest(map_entries(vector)) x from sparse_records) where x.value is not null
)
select rec_no, other, score, rank from (
  select *, cast(row_number() over (partition by rec_no order by score desc, other) as integer) rank from (
    select a.rec_no, b.rec_no other, sum(a.w * b.w) score from e a join e b on a.token = b.token and a.rec_no <> b.rec_no
    where a.rec_no % 50 = 0 group by all)
  where score >= 8.0)
where rank <= 5
"""


_P4 = """
with words as (
  select rec_no, regexp_extract_all(lower(content), '[a-z0-9]+') w from sparse_records where content is not null
), grams as (
  select distinct rec_no, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) g from words where len(w) >= 8
), sizes as (
  select rec_no, count(*) n from grams group by rec_no
), common as (
  select a.rec_no rec_a, b.rec_no rec_b, count(*) n from grams a join grams b on a.g = b.g and a.rec_no < b.rec_no group by all
)
select rec_a, rec_b from common c join sizes a on a.rec_no = rec_a join sizes b on b.rec_no = rec_b where c.n * 10 >= 6 * (a.n + b.n - c.n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"select * from ({_P2.format(cols='')}) where mark is not null",
        "p2_counts": _P2.format(cols="n_entries, n_records,"),
        "p3_exact": _P3,
        "p4_found": _P4,
    }
