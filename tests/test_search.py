"""Search, blocks and summaries against a model in plain Python, and the cases known from hand calculation."""

import heapq
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.functions import packed
from lexivane.functions.quantise import FIXED_BITS, fixed_code, fixed_scale, quantise, round_float
from lexivane.operators import blocks, knn, prune, search, summaries, vectors
from lexivane.operators.ranking import global_rank
from lexivane.session import cut

FORWARD = "rec_no long, component int, w double"
QUERY = "query_id string, component int, qw double"


def collection(seed, n=60, dim=12, nnz=5):
    rng = random.Random(seed)
    docs = {r: {c: rng.randint(1, 64) / 8 for c in rng.sample(range(dim), rng.randint(0, nnz))} for r in range(n)}
    queries = {f"q{i}": {c: rng.randint(1, 64) / 8 for c in rng.sample(range(dim), rng.randint(1, nnz))} for i in range(12)}
    return docs, queries


def frames(spark, docs, queries):
    forward = spark.createDataFrame([(r, c, w) for r, v in docs.items() for c, w in v.items()], FORWARD)
    return forward, spark.createDataFrame([(q, c, w) for q, v in queries.items() for c, w in v.items()], QUERY)


def dot(a, b):
    return sum(w * b[c] for c, w in a.items() if c in b)


def model(docs, queries, n_postings, size, k, cut, factor, first_sorted):
    """Sequential search over fixed blocks with exact summaries; also how many blocks it skipped."""
    lists = defaultdict(list)
    for r, v in docs.items():
        for c, w in v.items():
            lists[c].append((-w, r))
    lists = {c: [r for _, r in sorted(p)[:n_postings]] for c, p in lists.items()}
    out, skipped = {}, 0
    for q, v in queries.items():
        heap, seen = [], set()
        for i, (c, _) in enumerate(sorted(v.items(), key=lambda x: (-x[1], x[0]))[:cut]):
            own = lists.get(c, [])
            n = len(own) // size
            parts = [own[b * size : (b + 1) * size if b < n - 1 else len(own)] for b in range(n)]
            tops = []
            for p in parts:
                top = defaultdict(float)
                for r in p:
                    for cc, w in docs[r].items():
                        top[cc] = max(top[cc], w)
                tops.append(dot(v, top))
            order = sorted(range(n), key=lambda b: (-tops[b], b)) if i == 0 and first_sorted else range(n)
            for b in order:
                if len(heap) == k and tops[b] < factor * heap[0][0]:
                    skipped += 1
                    continue
                for r in parts[b]:
                    if r not in seen:
                        seen.add(r)
                        heapq.heappush(heap, (dot(v, docs[r]), -r))
                        if len(heap) > k:
                            heapq.heappop(heap)
        out[q] = [(-r, s) for s, r in sorted(heap, reverse=True)]
    return {q: h for q, h in out.items() if h}, skipped


def as_lists(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.rec_no, r.score))
    return dict(out)


def exact_codes(maxima):
    return maxima.select("component", "block", "c", F.lit(0).alias("code"), F.col("w").alias("low"), F.lit(0.0).alias("step"))


@pytest.mark.parametrize(("k", "size", "factor", "first_sorted"), [(3, 2, 0.0, True), (3, 2, 0.9, True), (3, 2, 1.6, False), (2, 3, 1.2, True), (5, 2, 1.0, False)])
def test_skipping_follows_the_sequential_search(spark, k, size, factor, first_sorted):
    docs, queries = collection(7)
    forward, asked = frames(spark, docs, queries)
    fixed = blocks.block_fixed(prune.prune_fixed(forward, 15), size)
    codes = exact_codes(summaries.block_max(fixed, forward))
    want, n_skipped = model(docs, queries, 15, size, k, 4, factor, first_sorted)
    got = search.skipping_topk(asked, fixed, codes, forward, k, 4, factor, first_sorted)
    assert as_lists(got) == want
    assert got.groupBy("query_id").agg(F.first("n_skipped").alias("n")).agg(F.sum("n")).first()[0] == n_skipped
    assert (n_skipped > 0) == (factor > 0)


@pytest.mark.parametrize("lowest", [0, -6])
def test_without_factor_no_estimate_is_needed(spark, lowest):
    """Nothing can be skipped then, unless weights are negative: only then the summaries are read."""
    docs, queries = collection(7)
    queries = {q: {c: w + lowest for c, w in v.items()} for q, v in queries.items()}
    forward, asked = frames(spark, docs, queries)
    fixed = blocks.block_fixed(prune.prune_fixed(forward, 15), 2)
    codes = exact_codes(summaries.block_max(fixed, forward))
    want, n_skipped = model(docs, queries, 15, 2, 3, 4, 0.0, True)
    assert (n_skipped > 0) == (lowest < 0)
    if not lowest:
        codes = codes.withColumn("low", F.raise_error(F.lit("read")).cast("double"))
    got = search.skipping_topk(asked, fixed, codes, forward, 3, 4, 0.0)
    assert as_lists(got) == want
    assert dict(got.dtypes)["n_skipped"] == "int" and got.groupBy("query_id").agg(F.first("n_skipped").alias("n")).agg(F.sum("n")).first()[0] == n_skipped


def test_without_cuts_all_searches_agree(spark):
    docs, queries = collection(11)
    forward, asked = frames(spark, docs, queries)
    want = {q: sorted(((r, dot(v, d)) for r, d in docs.items() if dot(v, d) > 0), key=lambda x: (-x[1], x[0]))[:4] for q, v in queries.items()}
    want = {q: h for q, h in want.items() if h}
    postings = prune.prune_fixed(forward, 1000)
    assert as_lists(search.candidate_topk(asked, postings, forward, 4, 100)) == want
    records = spark.createDataFrame([(r, {f"t{c}": w for c, w in v.items()}) for r, v in docs.items()], "rec_no long, vector map<string,double>")
    raw = spark.createDataFrame([(q, {f"t{c}": w for c, w in v.items()}) for q, v in queries.items()], "id string, vector map<string,double>")
    for block in (5, 4096):
        assert as_lists(search.exact_topk(records, raw, 4, block=block)) == want
    assert search.exact_topk(records, raw.limit(0), 4).count() == 0 and search.exact_topk(records.limit(0), raw, 4).count() == 0
    with pytest.raises(ValueError):
        search.exact_topk(records, raw, 0)


@pytest.mark.parametrize(("k", "n_postings", "factor", "first_sorted"), [(4, 6, 0.9, True), (4, 6, 0.9, False), (6, 4, 1.3, True), (1, 60, 1.1, True)])
def test_skipping_pairs_nothing(spark, monkeypatch, k, n_postings, factor, first_sorted):
    """Lists are scored as wholes, also with some or all lists shorter than k; no pair of a query and a record is shuffled."""

    def refused(*_):
        raise AssertionError("pairs are shuffled")

    monkeypatch.setattr(search, "score", refused)
    docs, queries = collection(9, 100, 60, 8)
    forward, asked = frames(spark, docs, queries)
    fixed = blocks.block_fixed(prune.prune_fixed(forward, n_postings), 1)
    want, n_skipped = model(docs, queries, n_postings, 1, k, 6, factor, first_sorted)
    got = search.skipping_topk(asked, fixed, exact_codes(summaries.block_max(fixed, forward)), forward, k, 6, factor, first_sorted)
    assert as_lists(got) == want and n_skipped > 0
    assert got.groupBy("query_id").agg(F.first("n_skipped").alias("n")).agg(F.sum("n")).first()[0] == n_skipped


@pytest.mark.parametrize("energy", [0.0, 0.4, 1.0])
def test_lists_are_summarised_as_by_the_operators(spark, energy):
    docs, _ = collection(4, 80)
    forward, _ = frames(spark, docs, {"q": {0: 1.0}})
    fixed = blocks.block_fixed(prune.prune_fixed(forward, 20), 3)
    codes = summaries.quantise_summaries(summaries.summary_energy(summaries.block_max(fixed, forward), energy))
    want, got = (sorted(map(tuple, x.fillna(-1).collect())) for x in (search.lists_of(fixed, forward, codes), search.summarised_lists(fixed, forward, energy)))
    assert want == got


def test_hand_calculated(spark):
    docs = {0: {0: 1, 1: 2, 4: 3}, 1: {}, 2: {}, 3: {0: 1, 1: 2, 2: 3, 3: 4}}
    forward, asked = frames(spark, {r: {c: float(w) for c, w in v.items()} for r, v in docs.items()}, {"q": {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}})
    postings = prune.prune_global(forward, 3500, 1.5, 5)
    built = cut(blocks.block_kmeans(cut(postings, "t"), forward), "t")
    codes = cut(summaries.quantise_summaries(summaries.summary_energy(summaries.block_max(built, forward))), "t")
    assert as_lists(
        search.skipping_topk(asked, built, codes, forward, 10, 5, 0.7)
    ) == {"q": [(3, 30.0), (0, 5.0)]}
    toy, one = frames(spark, {0: {0: 1.0, 2: 2.0, 4: 3.0}, 1: {1: 4.0, 3: 5.0}, 2: {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}}, {"q": {0: 1.0, 1: 2.0}})
    assert as_lists(search.candidate_topk(one, prune.prune_fixed(toy, 10), toy, 1)) == {"q": [(1, 8.0)]}


def test_fixed_blocks_take_the_rest_and_short_lists_have_none(spark):
    rows = [(r, c, 1.0) for c, n in ((0, 1), (1, 2), (2, 5), (3, 4)) for r in range(n)]
    got = blocks.block_fixed(prune.prune_fixed(spark.createDataFrame(rows, FORWARD), 100), 2)
    sizes = {(r.component, r.block): r["count"] for r in got.groupBy("component", "block").count().collect()}
    assert sizes == {(1, 0): 2, (2, 0): 2, (2, 1): 3, (3, 0): 2, (3, 1): 2}


def test_all_clusters_too_small_go_to_the_first_centroid(spark):
    rows = [(r, 0, 1.0) for r in range(4)] + [(r, 1 + r, 5.0) for r in range(4)]
    forward = spark.createDataFrame(rows, FORWARD)
    postings = prune.prune_fixed(forward, 100).where("component = 0")
    cents = blocks.centroids(postings, 1.0)
    got = blocks.clusters(postings, forward, cents).collect()
    assert len({r.first for r in got}) == 4 and [r.ord for r in got] == [1, 1, 1, 1]
    kept = blocks.clusters(postings, forward, cents, keep_dissolved=True).collect()
    assert len({r.ord for r in kept}) == 4


@pytest.mark.parametrize("most", [1, 3, 100])
def test_products_of_packed_vectors(monkeypatch, most):
    """In matrices of any size, also with empty vectors and none at all."""
    monkeypatch.setattr(packed, "CELLS", most)
    docs, queries = collection(8)

    def rows(vectors):
        own = [sorted(v.items()) for v in vectors]
        flat = [x for v in own for x in v]
        return packed.Vectors(np.append(0, np.cumsum([len(v) for v in own])), np.array([c for c, _ in flat], np.int32), np.array([w for _, w in flat], float))

    q, d = rows(queries.values()), rows(docs.values())
    got = np.concatenate([m for _, m in q.products(d)])
    assert np.array_equal(got, [[dot(a, b) for b in docs.values()] for a in queries.values()])
    shared = np.concatenate([m for _, m in q.touches(d)])
    assert np.array_equal(shared, [[bool(set(a) & set(b)) for b in docs.values()] for a in queries.values()])
    assert [m.shape for _, m in rows([{}]).products(d)] == [(1, 60)] and list(rows([]).products(d)) == []
    heavy = d.heaviest(2)
    assert [sorted(heavy.components[a:z]) for a, z in zip(heavy.starts[:-1], heavy.starts[1:])] == [sorted(c for c, _ in sorted(v.items(), key=lambda x: (-x[1], x[0]))[:2]) for v in docs.values()]


@pytest.mark.parametrize("sorted_", [True, False])
def test_pruned_search(spark, sorted_):
    """Without a factor all records of the lists are scored; with one, fewer, and a block that a sequential search visits is scored as well."""
    docs, queries = collection(6, 400, 12, 6)
    forward, asked = frames(spark, docs, queries)
    fixed = cut(blocks.block_fixed(prune.prune_fixed(forward, 100), 4), "t")
    codes = summaries.quantise_summaries(summaries.summary_energy(summaries.block_max(fixed, forward), 1.0))
    lists = cut(search.lists_of(fixed, forward, codes), "t")
    want = as_lists(search.skipping_topk(asked, fixed, codes, forward, 4, 3, 0.0))
    every = search.pruned_topk(asked, lists, 4, 3, 0.0, sorted_).collect()
    assert as_lists(spark.createDataFrame(every)) == want and all(r.n_scored == r.n_inside > 0 for r in every)
    some = search.pruned_topk(asked, lists, 4, 3, 0.9, sorted_).collect()
    assert sum(r.n_scored for r in some) < 0.7 * sum(r.n_inside for r in some)
    kth = {r.query_id: r.score for r in search.skipping_topk(asked, fixed, codes, forward, 4, 3, 0.9, sorted_).where("rank = 4").collect()}
    assert kth and all(r.score >= kth[r.query_id] for r in some if r["rank"] == 4 and r.query_id in kth)
    assert search.pruned_topk(asked.limit(0), lists, 4, 3, 0.9).count() == 0 and search.pruned_topk(asked, lists.limit(0), 4, 3, 0.9).count() == 0


def test_energy_takes_the_element_that_reaches_it(spark):
    maxima = spark.createDataFrame([(0, 0, c, w) for c, w in enumerate([4.0, 3.0, 2.0, 1.0])], "component int, block int, c int, w double")
    kept = {e: sorted(r.c for r in summaries.summary_energy(maxima, e).collect()) for e in (0.0, 0.4, 0.41, 0.7, 1.0)}
    assert kept == {0.0: [0], 0.4: [0], 0.41: [0, 1], 0.7: [0, 1], 1.0: [0, 1, 2, 3]}


def test_constant_block_has_step_zero(spark):
    maxima = spark.createDataFrame([(0, 0, 1, 2.5), (0, 0, 2, 2.5), (1, 0, 1, 0.0), (1, 0, 2, 255.0)], "component int, block int, c int, w double")
    got = {(r.component, r.c): (r.code, r.low, r.step) for r in summaries.quantise_summaries(maxima).collect()}
    assert got == {(0, 1): (0, 2.5, 0.0), (0, 2): (0, 2.5, 0.0), (1, 1): (0, 0.0, 1.0), (1, 2): (255, 0.0, 1.0)}


def test_a_block_that_shares_nothing_is_estimated_0(spark):
    forward, asked = frames(spark, {0: {0: 1.0, 1: 9.0}, 1: {0: 1.0, 1: 9.0}}, {"q": {0: 1.0}})
    fixed = blocks.block_fixed(prune.prune_fixed(forward, 10), 2)
    codes = summaries.quantise_summaries(summaries.summary_energy(summaries.block_max(fixed, forward), 0.1))
    est = summaries.block_estimates(search.query_cut(asked, 1), asked, fixed, codes).collect()
    assert [(r.component, r.est) for r in est] == [(0, 0.0)]


@pytest.mark.parametrize("kinds", [3, 1000])
def test_the_heaviest_of_all_entries(spark, kinds):
    """With many ties, and with none."""
    rng = random.Random(kinds)
    rows = [(r, c, rng.randrange(1, kinds) / 64) for r in range(120) for c in rng.sample(range(9), 5)]
    forward = spark.createDataFrame(rows, FORWARD)
    for n in (1, 7, 40, 66, 67, 1000):
        got = {(r.component, r.rec_no) for r in prune.prune_global(forward, n, 100.0, 9).collect()}
        assert got == {(c, r) for r, c, _ in sorted(rows, key=lambda x: (-x[2], x[1], x[0]))[: 9 * n]}


def test_global_prune_does_not_replace(spark):
    rows = [(r, 0, 10.0 - r) for r in range(6)] + [(0, 1, 1.0), (1, 1, 0.5)]
    got = prune.prune_global(spark.createDataFrame(rows, FORWARD), 2, 1.5, 2).collect()
    assert sorted((r.component, r.rec_no) for r in got) == [(0, 0), (0, 1), (0, 2)]


def test_neighbours_and_refinement(spark):
    docs, queries = collection(5, 30)
    forward, asked = frames(spark, docs, queries)
    postings = prune.prune_fixed(forward, 1000)
    graph = knn.candidate_graph(forward, postings, 3, 100)
    for r in graph.collect():
        assert r.rec_no != r.neighbour and r.score == dot(docs[r.rec_no], docs[r.neighbour])
    assert knn.knn_len(graph) == 3 and knn.knn_len(None) == 0
    assert knn.limit_graph(graph, 2).agg(F.max("rank")).first()[0] == 2
    with pytest.raises(ValueError):
        knn.limit_graph(graph, 4)
    few = search.candidate_topk(asked, prune.prune_fixed(forward, 2), forward, 4, 1)
    more = as_lists(search.refine(few, graph, asked, forward, 4, 3))
    for q, hits in as_lists(few).items():
        near = {n for r, _ in hits for n in [x.neighbour for x in graph.where(F.col("rec_no") == r).collect()]}
        want = sorted({(r, dot(queries[q], docs[r])) for r in {h[0] for h in hits} | near if dot(queries[q], docs[r]) > 0}, key=lambda x: (-x[1], x[0]))[:4]
        assert more[q] == want


def test_floats_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.uniform(0, 8, 2000), 2.0 ** rng.uniform(-26, 15, 2000), 2.0 ** np.arange(-25, 16), [1 + 2**-11, 1 + 3 * 2**-11, 65504.0, 65519.0, 0.0]])
    x = np.concatenate([x, -x]).astype(np.float32)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    got = np.array([r.g for r in rows.withColumn("g", round_float(F.col("v"), "f16")).orderBy("i").collect()])
    assert np.array_equal(got, x.astype(np.float16).astype(np.float64))
    top = spark.createDataFrame([(1e9,), (-1e9,), (None,), (float("nan"),)], "v double").select(round_float(F.col("v"), "f16")).collect()
    assert [r[0] for r in top[:3]] == [65504.0, -65504.0, None] and top[3][0] != top[3][0]
    bits = x.view(np.uint32).astype(np.uint64)
    half = ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16 << 16).astype(np.uint32).view(np.float32)
    got = np.array([r.g for r in rows.withColumn("g", round_float(F.col("v"), "bf16")).orderBy("i").collect()])
    assert np.array_equal(got, half.astype(np.float64))


def test_fixed_point(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.55,)], "w double")
    for kind in FIXED_BITS:
        scale = fixed_scale(df, "w", kind)
        codes = [r[0] for r in df.select(fixed_code(F.col("w"), scale, kind)).collect()]
        assert codes[0] == 0 and codes[-1] == 2 ** FIXED_BITS[kind] - 1
        assert all(abs(a[0] - b[0]) <= scale for a, b in zip(df.collect(), quantise(df, "w", kind).collect()))
    assert fixed_scale(df.where("w < 0"), "w", "fixedu8") == 1.0


def test_global_rank_is_row_number(spark):
    rows = [(i * 37 % 101, i) for i in range(500)]
    got = global_rank(spark.createDataFrame(rows, "a int, b int"), ["a", "b"]).collect()
    assert {(r.a, r.b): r["rank"] for r in got} == {x: i + 1 for i, x in enumerate(sorted(rows))}
    assert global_rank(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_strict_encoding_and_unknown_tokens(spark):
    records = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, None), (3, {})], "rec_no long, vector map<string,double>")
    long = vectors.entries(records)
    tokens = spark.createDataFrame([("a", 0)], "token string, component int")
    assert [(r.component, r.w) for r in vectors.encode(long, tokens).collect()] == [(0, 1.0)]
    with pytest.raises(Exception, match="token without a component"):
        vectors.encode(long, tokens, strict=True).collect()
    stats = vectors.corpus_stats(records).first()
    assert (stats.len, stats.dim, stats.nnz, stats.n_empty) == (3, 2, 2, 2)


@pytest.mark.parametrize("values", ["eighths", "any", "infinite"])
def test_best_others_are_those_of_all_products(values):
    """Near products choose, exact ones decide: the same rows and the same bits as from all products, with ties, in dense and rare components."""
    rng = np.random.default_rng(5)

    def some(n):
        rows = [np.unique(np.append(rng.integers(0, 12, 6), 12 + rng.integers(0, 400, 3))) for _ in range(n)]
        starts = np.append(0, np.cumsum([len(r) for r in rows]))
        w = rng.integers(1, 9, starts[-1]) / 8 if values == "eighths" else rng.random(starts[-1]) * 10.0 ** rng.integers(-40, 40, starts[-1])
        if values == "infinite":
            w[::50] = np.inf
        return packed.Vectors(starts, np.concatenate(rows).astype(np.int32), w)

    for n, m, k in ((200, 150, 5), (3, 40, 5), (1, 1, 2)):
        d, q, ids = some(n), some(m), rng.permutation(n)
        want, every = [], np.concatenate([s for _, s in q.products(d)])
        for i, row in enumerate(every):
            want += [(i, j, row[j]) for j in np.lexsort((ids, -row))[:k]]
        got = [x for row, col, score in q.best(d, ids, k) for x in zip(row, col, score)]
        assert got == want
        rows, cols = np.divmod(np.arange(m * n), n)
        assert values == "infinite" or q.dots(rows, d, cols).tolist() == every.ravel().tolist()


@pytest.mark.parametrize(("few", "together"), [(0, 0), (0, 10**6), (10**6, 10**6), (4, 30)])
def test_short_lists_are_searched_together(spark, monkeypatch, few, together):
    docs, queries = collection(11, n=120)
    forward, asked = frames(spark, docs, queries)
    postings = prune.prune_fixed(forward, 25)
    monkeypatch.setattr(search, "_FEW", few)
    monkeypatch.setattr(search, "_TOGETHER", together)
    monkeypatch.setattr(search, "_VISITORS", 2)
    lists = defaultdict(set)
    for r in postings.collect():
        lists[r.component].add(r.rec_no)
    want = {}
    for q, v in queries.items():
        near = set().union(*(lists[c] for c, _ in sorted(v.items(), key=lambda x: (-x[1], x[0]))[:3]))
        want[q] = sorted(((r, dot(v, docs[r])) for r in near), key=lambda x: (-x[1], x[0]))[:4]
    assert as_lists(search.candidate_topk(asked, postings, forward, 4, 3)) == {q: h for q, h in want.items() if h}


@pytest.mark.parametrize(("algorithm", "kept", "short"), [("approx", (0.4, 0), 256), ("approx", (None, 2), 8), ("exact", (0.7, 0), 0), ("inverted", (None, 3), 8)])
def test_lists_are_clustered_and_summed_up_in_one_task(spark, monkeypatch, algorithm, kept, short):
    """The same blocks and codes as step by step."""
    docs, _ = collection(3, n=150)
    forward, _ = frames(spark, docs, {"q": {0: 1.0}})
    postings = prune.prune_fixed(forward.where("component > 0 or rec_no < 6"), 40)
    monkeypatch.setattr(blocks, "_SHORT", short)
    both = cut(blocks.summarised_kmeans(postings, forward, 0.2, 1, algorithm, 3, 0.1, *kept), "both")
    stepwise = cut(blocks.block_kmeans(postings, forward, 0.2, 1, algorithm, 3, 0.1), "stepwise")
    got = both.select("component", "block", F.explode("rec_nos").alias("rec_no"))
    assert sorted(got.collect()) == sorted(stepwise.collect())
    maxima = summaries.block_max(stepwise, forward)
    codes = summaries.quantise_summaries(summaries.summary_fixed(maxima, kept[1]) if kept[0] is None else summaries.summary_energy(maxima, kept[0]))
    got = both.select("component", "block", F.explode(F.arrays_zip("c", "code")).alias("e"), "low", "step").select("component", "block", "e.c", "e.code", "low", "step")
    assert sorted(got.collect()) == sorted(codes.collect()) and got.schema.simpleString() == codes.schema.simpleString()


@pytest.mark.parametrize("algorithm", ["approx", "exact"])
def test_near_products_choose_the_same_centroids(monkeypatch, algorithm):
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(90)]
    whole = packed.Vectors(np.arange(91) * 8, np.concatenate(rows).astype(np.int32), rng.integers(0, 5, 720) / 4)
    center, found = rng.permutation(90)[:25], []
    for small in (10**9, 0):
        monkeypatch.setattr(blocks, "_SMALL", small)
        found.append(blocks._assigned(whole, center, algorithm, 2, 5, 0.1, False))
    assert all(np.array_equal(a, b) for a, b in zip(*found)) and len(np.unique(found[0][1])) > 1
