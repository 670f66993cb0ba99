"""The registered retrieval queries over sparse_records, sparse_queries, qrels and run_results, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions import quantise
from lexivane.operators import blocks, knn, metrics, prune, search, summaries, tuning, vectors
from lexivane.session import cut, spread, table

#: Knobs of the registered queries: those of a production index.
N_POSTINGS, MAX_FRACTION, ALPHA, BLOCK_SIZE = 3500, 1.5, 0.15, 10
CENTROIDS, MIN_CLUSTER, ENERGY, N_SUMMARY = 0.1, 2, 0.4, 50
K, CUT, HEAP_FACTOR, DIM, PRUNING_FACTOR = 10, 10, 0.7, 10, 0.005
if os.environ.get("LEXIVANE_SMALL_KNOBS"):  # tests: small enough for every branch (full lists, dissolved clusters, skipped blocks) to occur on small tables
    N_POSTINGS, MAX_FRACTION, ALPHA, BLOCK_SIZE = 12, 1.5, 0.3, 4
    CENTROIDS, MIN_CLUSTER, ENERGY, N_SUMMARY = 0.34, 1, 0.4, 8
    K, CUT, HEAP_FACTOR, DIM, PRUNING_FACTOR = 10, 5, 0.9, 5, 0.1


class Data:
    """The tables of a directory, as the operators take them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.sf_dir = sf_dir
        self.records, self.raw_queries = table(spark, sf_dir, "sparse_records"), table(spark, sf_dir, "sparse_queries")
        self.run, self.qrels = table(spark, sf_dir, "run_results"), table(spark, sf_dir, "qrels")

    @cached_property
    def long(self) -> DataFrame:
        return vectors.entries(self.records)

    @cached_property
    def tokens(self) -> DataFrame:
        return vectors.token_map(self.long)

    @cached_property
    def forward(self) -> DataFrame:
        return vectors.encode(self.long, self.tokens)

    @cached_property
    def queries(self) -> DataFrame:
        return search.resolve(self.raw_queries, self.tokens)

    @cached_property
    def stored(self) -> DataFrame:
        """forward, written once: for plans that read it several times."""
        return cut(self.forward, "forward")

    @cached_property
    def postings(self) -> DataFrame:
        return cut(prune.prune_fixed(self.stored, N_POSTINGS), "postings")

    @cached_property
    def cents(self) -> DataFrame:
        return blocks.centroids(self.postings, CENTROIDS)

    def clusters(self, algorithm: str = "approx") -> DataFrame:
        return blocks.clusters(self.postings, self.stored, self.cents, algorithm, MIN_CLUSTER, pruning_factor=PRUNING_FACTOR)

    @cached_property
    def blocks(self) -> DataFrame:
        return blocks.block_kmeans(self.postings, self.stored, CENTROIDS, MIN_CLUSTER)

    @cached_property
    def maxima(self) -> DataFrame:
        return summaries.block_max(blocks.block_fixed(self.postings, BLOCK_SIZE), self.stored)

    @cached_property
    def codes(self) -> DataFrame:
        return summaries.quantise_summaries(summaries.summary_energy(self.maxima, ENERGY))

    @cached_property
    def lists(self) -> DataFrame:
        """The lists of an index with clusters as blocks, as a search reads them."""
        clustered = cut(self.blocks, "blocks")
        short = summaries.summary_energy(summaries.block_max(clustered, self.stored), ENERGY)
        return cut(search.lists_of(clustered, self.stored, summaries.quantise_summaries(short)), "lists")

    @cached_property
    def fixed_blocks(self) -> DataFrame:
        return blocks.block_fixed(self.postings, BLOCK_SIZE)

    @cached_property
    def fixed_lists(self) -> DataFrame:
        """The lists in blocks of one size, with summaries, as a search reads them."""
        return cut(search.summarised_lists(self.fixed_blocks, self.stored, ENERGY), "lists")


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    return f"with recursive {_VIEWS}\n{sql}"


def query(sql: str | None = None) -> Callable[[Callable[[Data], DataFrame]], Callable[[Data], DataFrame]]:
    """Registers a function of Data under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = with_views(sql)
        return f

    return register


#: What the SQL texts share: the collections and each stage of the construction.
_VIEWS = f"""
long as (
  select rec_no, e.key token, cast(e.value as double) w
  from (select rec_no, unnest(map_entries(vector)) e from sparse_records) where e.value is not null
), tokens as (
  select token, cast(dense_rank() over (order by token) - 1 as integer) component from (select distinct token from long)
), fwd as (
  select rec_no, component, w from long join tokens using (token)
), q as (
  select query_id, component, cast(e.value as double) qw
  from (select id query_id, unnest(map_entries(vector)) e from sparse_queries) s join tokens on tokens.token = s.e.key
), qcut as (
  select * from (select *, row_number() over (partition by query_id order by qw desc, component) list_rank from q) where list_rank <= {CUT}
), post as (
  select * from (select *, row_number() over (partition by component order by w desc, rec_no) pos from fwd) where pos <= {N_POSTINGS}
), fixed_blocks as (
  select component, cast(least((pos - 1) // {BLOCK_SIZE}, n // {BLOCK_SIZE} - 1) as integer) block, rec_no
  from (select *, count(*) over (partition by component) n from post) where n >= {BLOCK_SIZE}
), cents as (
  select component, rec_no centroid, ord from (
    select *, row_number() over (partition by component order by h, rec_no) ord from (
      select component, rec_no, count(*) over (partition by component) n, (rec_no * 2654435761 + cast(component as bigint) * 40503) % 1000003 h from post))
  where ord <= greatest(1, floor(cast(n as float) * cast({CENTROIDS} as float)))
), doc_cut as (
  select * from (select *, row_number() over (partition by rec_no order by w desc, component) r from fwd) where r <= 15
), cent_entries as (
  select c.component, c.ord, f.component c, f.w cw from cents c join fwd f on f.rec_no = c.centroid
), approx_scores as (
  select p.component, p.rec_no, e.ord, sum(d.w * e.cw) score
  from post p join doc_cut d using (rec_no) join cent_entries e on e.component = p.component and e.c = d.component group by all
), approx_first as (
  select p.component, p.rec_no, cast(coalesce(s.ord, (select max(ord) from cents c where c.component = p.component)) as integer) ord
  from post p left join (select component, rec_no, arg_max(ord, {{'s': score, 'o': ord}}) ord from approx_scores group by all) s using (component, rec_no)
), gone as (
  select component, ord from approx_first group by all having count(*) <= {MIN_CLUSTER}
), live as (
  select component, ord from cents anti join gone using (component, ord)
), moving as (
  select component, rec_no from approx_first semi join gone using (component, ord)
), moved as (
  select m.component, m.rec_no, cast(coalesce(s.ord, (select max(ord) from live l where l.component = m.component), 1) as integer) ord
  from moving m left join (
    select component, rec_no, arg_max(ord, {{'s': score, 'o': ord}}) ord from approx_scores semi join live using (component, ord) group by all
  ) s using (component, rec_no)
), approx_final as (
  select component, rec_no, ord from approx_first anti join gone using (component, ord) union all select * from moved
), maxima as (
  select b.component, b.block, f.component c, max(f.w) w from fixed_blocks b join fwd f using (rec_no) group by all
), energy as (
  select component, block, c, w from (
    select *, coalesce(sum(w) over (partition by component, block order by w desc, c rows between unbounded preceding and 1 preceding), 0) before,
      sum(w) over (partition by component, block) total from maxima)
  where before = 0 or before < total * cast({ENERGY} as double)
), codes as (
  select component, block, c, cast(coalesce(round((w - low) / nullif(step, 0)), 0) as smallint) code, low, step from (
    select *, min(w) over (partition by component, block) low,
      (max(w) over (partition by component, block) - min(w) over (partition by component, block)) / 255.0::double step from energy)
), cand as (
  select distinct query_id, rec_no from qcut join post using (component)
), cand_scores as (
  select query_id, rec_no, sum(qw * w) score from cand join q using (query_id) join fwd using (rec_no, component) group by all
), cand_top as (
  select * from (select *, cast(row_number() over (partition by query_id order by score desc, rec_no) as integer) rank from cand_scores) where rank <= {K}
), graph_cand as (
  select distinct a.rec_no query_id, p.rec_no from (
    select * from (select *, row_number() over (partition by rec_no order by w desc, component) r from fwd) where r <= 10
  ) a join post p using (component)
), graph as (
  select rec_no, rank, neighbour, score from (
    select query_id rec_no, rec_no neighbour, score, cast(row_number() over (partition by query_id order by score desc, rec_no) as integer) rank
    from (select query_id, g.rec_no, sum(a.w * b.w) score
          from graph_cand g join fwd a on a.rec_no = g.query_id join fwd b on b.rec_no = g.rec_no and b.component = a.component group by all)
    where query_id <> rec_no)
  where rank <= {DIM}
), clean_q as (
  select query_id, doc_id, max(coalesce(relevance, 0)) relevance from qrels where query_id is not null and doc_id is not null group by all
), clean_r as (
  select query_id, doc_id, cast(row_number() over (partition by query_id order by place, doc_id) as integer) rank
  from (select query_id, doc_id, min(rank_no) place from run_results group by all)
), wanted as (
  select * from clean_q where relevance > 0
), found as (
  select *, row_number() over (partition by query_id order by rank) nth from clean_r join wanted using (query_id, doc_id)
), per_query as (
  select w.query_id, coalesce(1.0::double / first, 0) rr, coalesce(dcg / best, 0) ndcg, coalesce(precisions / n, 0) ap
  from (select query_id, sum(case when place <= {K} then relevance / log2(place + 1) end) best, count(*) n
        from (select *, row_number() over (partition by query_id order by relevance desc, doc_id) place from wanted) group by query_id) w
  left join (select query_id, min(case when rank <= {K} then rank end) first, sum(case when rank <= {K} then relevance / log2(rank + 1) end) dcg,
               sum(nth / rank::double) precisions from found group by query_id) f using (query_id)
)"""

_HITS = "query_id, rec_no, score, rank"


@query("select count(*) len, (select count(distinct token) from long) dim, (select count(*) from long) nnz, count(*) filter (coalesce(cardinality(vector), 0) = 0) n_empty from sparse_records")
def corpus_stats(d: Data) -> DataFrame:
    return vectors.corpus_stats(d.records)


@query("select token, component from tokens")
def token_map(d: Data) -> DataFrame:
    return d.tokens


@query("select rec_no, component, w from fwd")
def forward_vectors(d: Data) -> DataFrame:
    return d.forward


@query("select component, count(*) n_postings, max(w) max_w from fwd group by component")
def posting_lengths(d: Data) -> DataFrame:
    return vectors.posting_lengths(d.forward)


@query("select query_id, component, qw from q")
def query_token_resolution(d: Data) -> DataFrame:
    return d.queries


@query("select query_id, component, qw, list_rank from qcut")
def query_cut(d: Data) -> DataFrame:
    return search.query_cut(d.queries, CUT)


@query(
    f"""select {_HITS} from (
  select query_id, rec_no, score, cast(row_number() over (partition by query_id order by score desc, rec_no) as integer) rank
  from (select query_id, rec_no, sum(qw * w) score from q join fwd using (component) group by all)) where rank <= {K}"""
)
def exact_topk(d: Data) -> DataFrame:
    return search.exact_topk(spread(d.records), d.raw_queries, K)


@query("select rec_no, component, w, pos from post")
def prune_fixed(d: Data) -> DataFrame:
    return prune.prune_fixed(d.forward, N_POSTINGS)


@query(
    f"""select rec_no, component, w, pos from (
  select *, row_number() over (partition by component order by w desc, rec_no) pos
  from (select * from fwd order by w desc, component, rec_no limit (select count(*) * {N_POSTINGS} from tokens)))
where pos <= {int(N_POSTINGS * MAX_FRACTION)}"""
)
def prune_global(d: Data) -> DataFrame:
    return prune.prune_global(d.forward, N_POSTINGS, MAX_FRACTION)


@query(
    f"""select rec_no, component, w, pos from (
  select *, row_number() over (partition by component order by w desc, rec_no) pos, count(*) over (partition by component) n from fwd)
where pos <= least({N_POSTINGS}, floor(n * cast({ALPHA} as double)) + 1)"""
)
def prune_coi(d: Data) -> DataFrame:
    return prune.prune_coi(d.forward, ALPHA, N_POSTINGS)


@query("select rec_no from post where component = 7")
def posting_docs(d: Data) -> DataFrame:
    return prune.prune_fixed(d.forward, N_POSTINGS).where("component = 7").select("rec_no")


@query("select component, block, rec_no from fixed_blocks")
def block_fixed(d: Data) -> DataFrame:
    return d.fixed_blocks


@query("select component, centroid, ord from cents")
def cluster_centroids(d: Data) -> DataFrame:
    return d.cents


@query("select component, rec_no, ord from approx_first")
def cluster_approx_assign(d: Data) -> DataFrame:
    return d.clusters().select("component", "rec_no", F.col("first").alias("ord"))


@query("select component, rec_no, ord from approx_final")
def cluster_dissolve_reassign(d: Data) -> DataFrame:
    return d.clusters().select("component", "rec_no", "ord")


_WHOLE_SCORES = """, scored as (
  select p.component, p.rec_no, e.ord, sum(f.w * e.cw) score
  from post p join fwd f using (rec_no) join cent_entries e on e.component = p.component and e.c = f.component group by all
)"""
_PROBED_SCORES = _WHOLE_SCORES.replace("scored", "every_score") + f""", scored as (
  select * from every_score semi join (
    select distinct p.component, p.rec_no, l.ord from post p join doc_cut d using (rec_no) join (
      select * from (select e.*, row_number() over (partition by e.component, e.c order by e.cw desc, e.ord) r, n
        from cent_entries e join (select component, count(*) n from post group by component) using (component))
      where r <= greatest(5, floor(cast(n as float) * cast({PRUNING_FACTOR} as float)))) l on l.component = p.component and l.c = d.component) y using (component, rec_no, ord)
)"""
_OWN_FIRST = """, first_of as (
  select p.component, p.rec_no, cast(coalesce(own.ord, s.ord, 1) as integer) ord
  from post p left join cents own on own.component = p.component and own.centroid = p.rec_no
  left join (select component, rec_no, arg_max(ord, {'s': score, 'o': -ord}) ord from scored group by all) s on s.component = p.component and s.rec_no = p.rec_no
)"""
_OWN_FINAL = f""", small as (
  select component, ord from first_of group by all having count(*) <= {MIN_CLUSTER}
), left_over as (
  select component, ord from cents anti join small using (component, ord)
)
select component, rec_no, ord from first_of anti join small using (component, ord) union all
select m.component, m.rec_no, cast(coalesce(s.ord, 1) as integer) from (select * from first_of semi join small using (component, ord)) m left join (
  select component, rec_no, arg_max(ord, {{'s': score, 'o': -ord}}) ord from scored semi join left_over using (component, ord) group by all
) s using (component, rec_no)"""


@query(_WHOLE_SCORES + _OWN_FIRST + " select component, rec_no, ord from first_of")
def cluster_exact_assign(d: Data) -> DataFrame:
    return d.clusters("exact").select("component", "rec_no", F.col("first").alias("ord"))


@query(_WHOLE_SCORES + _OWN_FIRST + _OWN_FINAL)
def cluster_exact_dissolve(d: Data) -> DataFrame:
    return d.clusters("exact").select("component", "rec_no", "ord")


@query(_PROBED_SCORES + _OWN_FIRST + " select component, rec_no, ord from first_of")
def cluster_inverted_assign(d: Data) -> DataFrame:
    return d.clusters("inverted").select("component", "rec_no", F.col("first").alias("ord"))


@query(_PROBED_SCORES + _OWN_FIRST + _OWN_FINAL)
def cluster_inverted_dissolve(d: Data) -> DataFrame:
    return d.clusters("inverted").select("component", "rec_no", "ord")


@query("select component, cast(dense_rank() over (partition by component order by ord) - 1 as integer) block, rec_no from approx_final")
def block_kmeans(d: Data) -> DataFrame:
    return d.blocks


@query("select component, block, c, w from maxima")
def block_max(d: Data) -> DataFrame:
    return d.maxima


@query(f"select component, block, c, w from (select *, row_number() over (partition by component, block order by w desc, c) r from maxima) where r <= {N_SUMMARY}")
def summary_fixed(d: Data) -> DataFrame:
    return summaries.summary_fixed(d.maxima, N_SUMMARY)


@query("select component, block, c, w from energy")
def summary_energy(d: Data) -> DataFrame:
    return summaries.summary_energy(d.maxima, ENERGY)


@query("select component, block, c, code, low, step from codes")
def summary_quantised(d: Data) -> DataFrame:
    return d.codes


@query(
    """select query_id, component, block, cast(list_rank as integer) list_rank, round(coalesce(est, 0), 6) est
from (select distinct query_id, list_rank, component, block from qcut join fixed_blocks using (component)) v
left join (select v.query_id, s.component, s.block, sum(q.qw * (low + code * step)) est
  from (select distinct query_id, component, block from qcut join fixed_blocks using (component)) v
  join codes s using (component, block) join q on q.query_id = v.query_id and q.component = s.c group by all) e using (query_id, component, block)"""
)
def block_estimates(d: Data) -> DataFrame:
    q = d.queries
    est = summaries.block_estimates(search.query_cut(q, CUT), q, d.fixed_blocks, d.codes)
    return est.withColumn("est", F.round("est", 6))


@query(f"select {_HITS} from cand_top")
def candidate_topk(d: Data) -> DataFrame:
    return search.candidate_topk(d.queries, d.postings, d.stored, K, CUT)


def _skip_sql(first_sorted: bool, k: int = 3, factor: float = HEAP_FACTOR) -> str:
    """The fold over a query's blocks; a state has the form of a block: est, n (skipped so far), docs (the heap)."""
    place = "case when list_rank = 1 then -est else 0 end" if first_sorted else "0"
    return f""", visits as (
  select query_id, list_rank, component, block, coalesce(est, 0) est
  from (select distinct query_id, list_rank, component, block from qcut join fixed_blocks using (component)) v
  left join (select v.query_id, s.component, s.block, sum(q.qw * (low + code * step)) est
    from (select distinct query_id, component, block from qcut join fixed_blocks using (component)) v
    join codes s using (component, block) join q on q.query_id = v.query_id and q.component = s.c group by all) e using (query_id, component, block)
), inside as (
  select query_id, component, block, rec_no from visits join fixed_blocks using (component, block)
), inside_scores as (
  select query_id, rec_no, sum(qw * w) score from (select distinct query_id, rec_no from inside) join q using (query_id) join fwd using (rec_no, component) group by all
), docs as (
  select query_id, component, block, list({{'s': -score, 'r': rec_no}}) docs from inside join inside_scores using (query_id, rec_no) group by all
), folded as (
  select query_id, list_reduce(
    list({{'est': est, 'n': 0::bigint, 'docs': docs}} order by list_rank, {place}, block),
    lambda a, x: case when len(a.docs) >= {k} and x.est < {factor}::double * -(a.docs[{k}].s)
      then {{'est': 0::double, 'n': a.n + 1, 'docs': a.docs}}
      else {{'est': 0::double, 'n': a.n, 'docs': list_slice(list_sort(list_distinct(list_concat(a.docs, x.docs))), 1, {k})}} end,
    {{'est': 0::double, 'n': 0::bigint, 'docs': []}}) state
  from visits join docs using (query_id, component, block) group by query_id
)
select query_id, h.r rec_no, -h.s score, cast(rank as integer) rank, cast(n as integer) n_skipped
from (select query_id, state.n n, unnest(state.docs) h, generate_subscripts(state.docs, 1) rank from folded)"""


@query(_skip_sql(True))
def skip_topk_sorted(d: Data) -> DataFrame:
    return search.skipping_lists(d.queries, d.fixed_lists, 3, CUT, HEAP_FACTOR, True)


@query(_skip_sql(False))
def skip_topk_unsorted(d: Data) -> DataFrame:
    return search.skipping_lists(d.queries, d.fixed_lists, 3, CUT, HEAP_FACTOR, False)


_ALL_BLOCKS = f"""select {_HITS} from (select *, cast(row_number() over (partition by query_id order by score desc, rec_no) as integer) rank from (
  select query_id, rec_no, sum(qw * w) score from (select distinct query_id, rec_no from qcut join fixed_blocks using (component))
  join q using (query_id) join fwd using (rec_no, component) group by all)) where rank <= {K}"""


@query(f"select {_HITS} from cand_top")
def pruned_topk_factor_zero(d: Data) -> DataFrame:
    return search.pruned_topk(d.queries, d.lists, K, CUT, 0.0).select("query_id", "rec_no", "score", "rank")


@query()
def pruned_topk(d: Data) -> DataFrame:
    return search.pruned_topk(d.queries, d.lists, K, CUT, HEAP_FACTOR)


@query()
def pruned_recall(d: Data) -> DataFrame:
    """One row: recall of pruned_topk against exact search, and the share of the records in the visited lists that were scored."""
    hits = cut(search.pruned_topk(d.queries, d.lists, K, CUT, HEAP_FACTOR), "hits").withColumnRenamed("rec_no", "doc_id")
    truth = search.exact_topk(spread(d.records), d.raw_queries, K).withColumnRenamed("rec_no", "doc_id")
    work = hits.where("rank = 1").agg(F.sum("n_scored").alias("n_scored"), F.sum("n_inside").alias("n_inside"))
    return metrics.accuracy_at_k(hits, truth, K).select("*", *[work.select(c).scalar().alias(c) for c in work.columns])


@query(_ALL_BLOCKS)
def skip_topk_factor_zero(d: Data) -> DataFrame:
    """With heap_factor 0 nothing can be skipped: the result is that of a search of all blocks."""
    return search.skipping_topk(d.queries, d.fixed_blocks, d.codes, d.stored, K, CUT, 0.0).drop("n_skipped")


@query("select rec_no, rank, neighbour, score from graph")
def candidate_graph(d: Data) -> DataFrame:
    return knn.candidate_graph(d.stored, d.postings, DIM)


@query("select rec_no, rank, neighbour, score from graph where rank <= 2")
def knn_limit(d: Data) -> DataFrame:
    return knn.limit_graph(knn.candidate_graph(d.stored, d.postings, DIM), 2)


@query()
def knn_graph(d: Data) -> DataFrame:
    """Self-search with summaries; the test compares it with candidate_graph."""
    return knn.knn_graph(d.stored, d.fixed_blocks, d.codes, DIM)


@query("select rec_no, rank, neighbour, score from graph")
def knn_graph_factor_zero(d: Data) -> DataFrame:
    """With heap_factor 0 no block is skipped: the graph over all candidates (of lists in blocks of one)."""
    single = blocks.block_fixed(d.postings, 1)
    codes = summaries.quantise_summaries(summaries.summary_energy(summaries.block_max(single, d.stored), ENERGY))
    return knn.knn_graph(d.stored, single, codes, DIM, heap_factor=0.0)


@query(
    f"""select {_HITS} from (select *, cast(row_number() over (partition by query_id order by score desc, rec_no) as integer) rank from (
  select query_id, rec_no, score from cand_top union all
  select query_id, rec_no, sum(qw * w) score from (
    select distinct query_id, neighbour rec_no from cand_top join graph using (rec_no)) n anti join cand_top using (query_id, rec_no)
  join q using (query_id) join fwd using (rec_no, component) group by all)) where rank <= {K}"""
)
def knn_refine_topk(d: Data) -> DataFrame:
    hits = search.candidate_topk(d.queries, d.postings, d.stored, K, CUT)
    return search.refine(hits, knn.candidate_graph(d.stored, d.postings, DIM), d.queries, d.stored, K, DIM)


@query("select query_id, coalesce(id, cast(rec_no as varchar)) doc_id, score, cand_top.rank from cand_top join sparse_records using (rec_no)")
def remap_ids(d: Data) -> DataFrame:
    return search.remap(search.candidate_topk(d.queries, d.postings, d.stored, K, CUT), vectors.doc_map(d.records))


@query(
    """select query_id, rec_no, score, cand_top.rank, doc_id, content from cand_top join (
  select rec_no, coalesce(id, cast(rec_no as varchar)) doc_id, min_by(content, rec_no) over (partition by coalesce(id, cast(rec_no as varchar))) content
  from sparse_records) using (rec_no)"""
)
def doc_text_join(d: Data) -> DataFrame:
    return search.with_text(search.candidate_topk(d.queries, d.postings, d.stored, K, CUT), vectors.doc_map(d.records))


@query(
    r"""select query_id, 'Question: ' || coalesce(s.content, '') || chr(10) || 'Passages:' || chr(10) || passages prompt from (
  select query_id, string_agg('[' || no || '] ' || content, chr(10) order by no) passages from (
    select query_id, content, row_number() over (partition by query_id order by rank) no from (
      select query_id, cand_top.rank, content from cand_top join (
        select rec_no, min_by(content, rec_no) over (partition by coalesce(id, cast(rec_no as varchar))) content from sparse_records) using (rec_no))
    where content is not null) group by query_id) p join sparse_queries s on s.id = p.query_id"""
)
def rag_prompt(d: Data) -> DataFrame:
    hits = search.candidate_topk(d.queries, d.postings, d.stored, K, CUT)
    return search.rag_prompts(hits, vectors.doc_map(d.records), d.raw_queries)


@query(
    f"""select coalesce(count(r.query_id) / nullif(count(*), 0)::double, 0) accuracy, count(r.query_id) n_hits, count(*) n_truth
from (select query_id, rec_no from (
    select query_id, rec_no, row_number() over (partition by query_id order by score desc, rec_no) rank
    from (select query_id, rec_no, sum(qw * w) score from q join fwd using (component) group by all)) where rank <= {K}) t
left join cand_top r on r.query_id = t.query_id and r.rec_no = t.rec_no"""
)
def recall_at_k(d: Data) -> DataFrame:
    truth = search.exact_topk(spread(d.records), d.raw_queries, K).withColumnRenamed("rec_no", "doc_id")
    run = search.candidate_topk(d.queries, d.postings, d.stored, K, CUT).withColumnRenamed("rec_no", "doc_id")
    return metrics.accuracy_at_k(run, truth, K)


def _metric(d: Data, name: str) -> DataFrame:
    return metrics.by_query(metrics.clean_run(d.run), metrics.clean_qrels(d.qrels), K).select("query_id", F.round(name, 9).alias(name))


@query("select query_id, round(rr, 9) rr from per_query")
def rr_at_10(d: Data) -> DataFrame:
    return _metric(d, "rr")


@query("select query_id, round(ndcg, 9) ndcg from per_query")
def ndcg_at_10(d: Data) -> DataFrame:
    return _metric(d, "ndcg")


@query("select query_id, round(ap, 9) ap from per_query")
def map_at_k(d: Data) -> DataFrame:
    return _metric(d, "ap")


@query("select id query_id, coalesce(n, 0) n from sparse_queries left join (select query_id, count(*) n from clean_r group by query_id) on query_id = id where coalesce(n, 0) < 10")
def short_results(d: Data) -> DataFrame:
    return metrics.short_results(metrics.clean_run(d.run), d.raw_queries, K)


#: Of a normal number: its exponent, then the multiple of the last place. The weights of the tables are below 2^16.
_ROUND = """select rec_no, component, w, sign(w) * round_even(abs(w) / unit, 0) * unit v
from (select *, pow(2.0, greatest(floor(log2(greatest(abs(w), 1e-300))), {lowest}) - {bits}) unit from fwd)"""


@query(_ROUND.format(lowest=-14, bits=10))
def quantise_f16(d: Data) -> DataFrame:
    return d.forward.withColumn("v", quantise.round_float(F.col("w"), "f16"))


@query(_ROUND.format(lowest=-126, bits=7))
def quantise_bf16(d: Data) -> DataFrame:
    return d.forward.withColumn("v", quantise.round_float(F.col("w"), "bf16"))


@query("select rec_no, component, cast(least(greatest(round(w / (select max(w) / 255.0::double from fwd)), 0), 255) as integer) code from fwd")
def quantise_fixedu8(d: Data) -> DataFrame:
    scale = quantise.fixed_scale(d.forward, "w", "fixedu8")
    return d.forward.select("rec_no", "component", quantise.fixed_code(F.col("w"), scale, "fixedu8").alias("code"))


@query("select rec_no, component, cast(least(greatest(round(w / (select max(w) / 65535.0::double from fwd)), 0), 65535) as integer) code from fwd")
def quantise_fixedu16(d: Data) -> DataFrame:
    scale = quantise.fixed_scale(d.forward, "w", "fixedu16")
    return d.forward.select("rec_no", "component", quantise.fixed_code(F.col("w"), scale, "fixedu16").alias("code"))


@query(
    """, reports as (
  select e.encoder_name name, cut, 10.0 * cut + e.encoder_id time, least(0.999, 0.85 + 0.01 * cut + 0.002 * e.encoder_id) recall, e.vocab_size memory
  from encoders e, (select unnest([1, 2, 4, 8, 12]) cut)
), levels as (select unnest(range(90, 101)) / 100.0::double level)
select level, arg_min(name, {'t': time, 'n': name, 'c': cut}) name, arg_min(cut, {'t': time, 'n': name, 'c': cut}) cut, cast(min(time) as double) time
from levels join reports on cast(recall as double) > level and memory <= 60000 group by level"""
)
def best_config(d: Data) -> DataFrame:
    return tuning.best_configs(tuning.sample_reports(table(d.records.sparkSession, d.sf_dir, "encoders")), "memory", 60000)


@query(
    """select distinct a.n n_postings, b.f centroid_fraction, case when c.p = 'global' then m.x end max_fraction, c.p pruning
from (select unnest([1000, 2000]) n) a, (select unnest([0.1::double, 0.2::double]) f) b, (select unnest(['fixed', 'global']) p) c, (select unnest([1.5::double, 3.0::double]) x) m"""
)
def grid_combinations(d: Data) -> DataFrame:
    grid = {"n_postings": [1000, 2000], "centroid_fraction": [0.1, 0.2], "pruning": ["fixed", "global"], "max_fraction": [1.5, 3.0]}
    rows = tuning.combinations(grid, {"max_fraction": ("pruning", "global")})
    spec = "n_postings int, centroid_fraction double, max_fraction double, pruning string"
    return d.records.sparkSession.createDataFrame([(r["n_postings"], r["centroid_fraction"], r["max_fraction"], r["pruning"]) for r in rows], spec)


@query(
    """select 'forward' part, count(*) n_rows, count(*) * 8 n_bytes from fwd union all select 'postings', count(*), count(*) * 8 from post
union all select 'token_map', count(*), sum(strlen(token) + 4) from tokens
union all select 'doc_map', count(*), sum(strlen(coalesce(id, cast(rec_no as varchar))) + coalesce(strlen(content), 0)) from sparse_records"""
)
def space_usage(d: Data) -> DataFrame:
    from lexivane.index import space_usage as usage

    return usage(forward=d.forward, postings=d.postings, token_map=d.tokens, doc_map=vectors.doc_map(d.records))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
