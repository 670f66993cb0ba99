"""The registered queries that write an index, a collection, lists or judgements, read them back and search them, and their SQL over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.config import Configuration
from lexivane.index import RawIndex, SparseDataset, SparseIndex
from lexivane.operators import knn, metrics, prune, tuning, vectors
from lexivane.plans import retrieval_queries as R
from lexivane.session import scratch_path, table
from lexivane.sources import records as sources


def _config(kind: str = "fixed") -> Configuration:
    config = Configuration().pruned(kind=kind, n_postings=R.N_POSTINGS, max_fraction=R.MAX_FRACTION).blocked(centroid_fraction=R.CENTROIDS, min_cluster_size=R.MIN_CLUSTER)
    return config.summarized(energy=R.ENERGY).with_value_type("f32")


def _saved(spark: SparkSession, sf_dir: str) -> SparseIndex:
    """An index of the records, built, saved and loaded."""
    index = SparseIndex.from_records(table(spark, sf_dir, "sparse_records"), _config())
    return SparseIndex.load(spark, index.save(scratch_path(spark, "index")))


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).postings.select("component", "rec_no", "pos")


def index_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).blocks


def index_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _saved(spark, sf_dir)
    return spark.createDataFrame([(index.len, index.dim, index.nnz, index.is_empty, index.knn_len)], "len long, dim long, nnz long, is_empty boolean, knn_len long")


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by tokens without skipping: all records of the visited lists."""
    return _saved(spark, sf_dir).search_tokens(table(spark, sf_dir, "sparse_queries"), R.K, R.CUT, 0.0)


def index_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of an index whose weights were converted to 8 bits after it was built."""
    return _saved(spark, sf_dir).convert("fixedu8").postings.select("component", "rec_no", "pos")


def index_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph attached to an index, saved, and loaded with its first two neighbours."""
    index = _saved(spark, sf_dir)
    index.add_knn(knn.candidate_graph(index.forward, index.postings, R.DIM))
    index.load_knn(index.save_knn(scratch_path(spark, "graph")), 2)
    return index.knn


def index_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven parts of an index."""
    index = _saved(spark, sf_dir)
    index.add_knn(knn.candidate_graph(index.forward, index.postings, R.DIM))
    return index.space_usage()


def posting_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean length of the pruned lists over all components."""
    d = R.Data(spark, sf_dir)
    return vectors.mean_list_length(prune.prune_fixed(d.stored, R.N_POSTINGS), d.tokens)


def binary_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward table written as a binary vector file and read back, numbered from 0 on."""
    path = scratch_path(spark, "vectors") + ".bin"
    sources.write_inner(vectors.wide(R.Data(spark, sf_dir).forward), path.removeprefix("file://"))
    back = sources.read_inner(spark, path).select("ordinal", F.explode(F.arrays_zip("components", "vals")).alias("e"))
    return back.select("ordinal", F.col("e.components").cast("int").alias("component"), F.col("e.vals").cast("double").alias("w"))


def binary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of an index over a binary vector file: component, ordinal, pos."""
    rows = binary_vectors(spark, sf_dir).withColumnRenamed("ordinal", "rec_no")
    return RawIndex.build(rows, _config()).postings.select("component", F.col("rec_no").alias("ordinal"), "pos")


def jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records written as jsonl and read back: id, content, number and sum of the weights."""
    path = scratch_path(spark, "records") + ".jsonl"
    table(spark, sf_dir, "sparse_records").select("id", "content", "vector").write.json(path)
    total = F.aggregate(F.map_values("vector"), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    back = sources.read_records(spark, path)
    return back.select("id", "content", F.coalesce(F.size("vector"), F.lit(0)).alias("n"), F.coalesce(total, F.lit(0.0)).alias("total"))


def dataset_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search, weights held as f16, in a dataset that got its records in two portions: scores by rank."""
    records = table(spark, sf_dir, "sparse_records")
    data = SparseDataset(spark)
    for portion in (records.where("rec_no % 3 = 0"), records.where("rec_no % 3 <> 0")):
        data.add_records(portion.select("id", "content", "vector"))
    return data.search_frame(table(spark, sf_dir, "sparse_queries"), R.K).select("query_id", "score", "rank")


def run_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists written as tab-separated text and read back."""
    path = scratch_path(spark, "run")
    sources.write_run(metrics.clean_run(table(spark, sf_dir, "run_results")).withColumn("score", F.lit(1.5)), path)
    return sources.read_run(spark, path)


def qrels_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements written in either order of columns and read back."""
    judged = table(spark, sf_dir, "qrels").select("query_id", "doc_id", "relevance").distinct()
    found = []
    for order in (["query_id", "useless", "doc_id", "relevance"], ["query_id", "doc_id", "relevance", "useless"]):
        path = scratch_path(spark, "qrels")
        judged.withColumn("useless", F.lit(0)).select(order).write.csv(path, sep="\t")
        found.append(sources.read_qrels(spark, path).withColumn("useless_first", F.lit(order[1] == "useless")))
    return found[0].unionByName(found[1])


def report_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best settings written as a report and read back."""
    path = scratch_path(spark, "report")
    sources.write_report(tuning.best_configs(tuning.sample_reports(table(spark, sf_dir, "encoders")), "memory", 60000), path)
    return spark.read.csv(path, sep="\t", header=True, schema="level double, name string, cut int, time double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (index_postings, index_blocks, index_facts, index_search, index_convert, index_knn, index_space, posting_average)
    every += (binary_vectors, binary_index, jsonl_records, dataset_growth, run_tsv, qrels_tsv, report_tsv)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    known = R.oracle_sql()
    postings = R.with_views("select component, rec_no, pos from post")
    ordinals = "(select rec_no, dense_rank() over (order by rec_no) - 1 ordinal from (select distinct rec_no from fwd)) o"
    judged = "(select distinct query_id, doc_id, relevance from qrels)"
    return {
        "index_postings": postings,
        "index_blocks": known["block_kmeans"],
        "index_facts": R.with_views(
            "select (select count(*) from sparse_records) len, (select count(*) from tokens) dim, (select count(*) from fwd) nnz, (select count(*) = 0 from fwd) is_empty, 0::bigint knn_len"
        ),
        "index_search": known["remap_ids"],
        "index_convert": postings,
        "index_knn": known["knn_limit"],
        "index_space": R.with_views(
            """, final_blocks as (
  select component, dense_rank() over (partition by component order by ord) - 1 block, rec_no from approx_final
), final_maxima as (
  select b.component, b.block, f.component c, max(f.w) w from final_blocks b join fwd f using (rec_no) group by all
), kept as (
  select 1 from (select *, coalesce(sum(w) over (partition by component, block order by w desc, c rows between unbounded preceding and 1 preceding), 0) before,
      sum(w) over (partition by component, block) total from final_maxima)
  where before = 0 or before < total * cast(%s as double)
)
select 'forward' part, count(*) n_rows, count(*) * 8 n_bytes from fwd union all select 'postings', count(*), count(*) * 8 from post
union all select 'blocks', count(*), count(*) * 8 from approx_final union all select 'codes', count(*), count(*) * 9 from kept
union all select 'knn', count(*), count(*) * 8 from graph union all select 'token_map', count(*), sum(strlen(token) + 4) from tokens
union all select 'doc_map', count(*), sum(strlen(coalesce(id, cast(rec_no as varchar))) + coalesce(strlen(content), 0)) from sparse_records"""
            % R.ENERGY
        ),
        "posting_average": R.with_views("select (select count(*) from post) / (select count(*) from tokens)::double mean_length"),
        "binary_vectors": R.with_views(f"select ordinal, component, w from fwd join {ordinals} using (rec_no)"),
        "binary_index": R.with_views(f"select component, ordinal, pos from post join {ordinals} using (rec_no)"),
        "jsonl_records": """select id, content, coalesce(cardinality(vector), 0)::integer n,
  coalesce(list_sum(list_transform(map_values(vector), lambda x: x::double)), 0) total from sparse_records""",
        "dataset_growth": R.with_views(
            ", rounded as (" + R._ROUND.format(lowest=-14, bits=10) + f""")
select query_id, score, cast(rank as integer) rank from (select *, row_number() over (partition by query_id order by score desc) rank from (
  select query_id, rec_no, sum(qw * v) score from q join rounded using (component) group by all)) where rank <= {R.K}"""
        ),
        "run_tsv": R.with_views("select query_id, doc_id, rank::bigint rank_no, 1.5::double score from clean_r"),
        "qrels_tsv": f"select * from {judged}, (select unnest([true, false]) useless_first)",
        "report_tsv": known["best_config"],
    }
