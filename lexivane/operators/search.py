"""Top-k search: exact, over candidates, and with blocks skipped.

queries: query_id, component, qw (as resolve gives them); forward: rec_no, component, w. Scores are whole inner
products in double precision; ties go to the lower rec_no. Records that share nothing with a query are no hits,
so a result may have fewer than k rows for a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions.packed import Vectors, best_of_rows, binary, numbers, pack, pack_maps
from lexivane.operators.ranking import top_by
from lexivane.operators.vectors import entries
from lexivane.session import cut as written

def _check_k(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


def resolve(queries: DataFrame, tokens: DataFrame, key: str = "id") -> DataFrame:
    """query_id, component, qw: the query vectors with their tokens numbered; tokens that no record has are left out."""
    long = entries(queries, key).select(F.col(key).alias("query_id"), "token", F.col("w").alias("qw"))
    return long.join(tokens, "token").select("query_id", "component", "qw")


def query_cut(queries: DataFrame, cut: int) -> DataFrame:
    """The cut heaviest components of each query, list_rank from 1 on in the order in which their lists are visited."""
    return top_by(queries, ["query_id"], [F.desc("qw"), "component"], cut, "list_rank")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    return top_by(scored, ["query_id"], [F.desc("score"), "rec_no"], k).select("query_id", "rec_no", "score", "rank")


def exact_topk(
    records: DataFrame, queries: DataFrame, k: int = 10, key: str = "rec_no", vector: str = "vector", query_key: str = "id", block: int = 4096, rows: int = 1 << 15
) -> DataFrame:
    """query_id, rec_no, score, rank: the k best records of each query over all records, of those that share a token with it.

    Records are dealt to parts of about rows rows, queries to blocks of about block rows; a part meets a block in one task,
    which multiplies them (in matrices of a bounded number of cells) and hands on the k best of each query. Nothing goes through the
    driver but two counts, and no task holds more than a part and a block. A batch of one block reads the records
    once. Scores may be 0 or less; tokens are compared by their 64-bit hashes. Queries with the same id are one query: the sum of their vectors.
    """
    _check_k(k)
    docs = pack_maps(records, key, vector)
    asked = pack_maps(queries.withColumnRenamed(query_key, "query_id"), "query_id", vector)
    parts, blocks = (max(1, -(-df.count() // n)) for df, n in ((records, rows), (queries, block)))

    def dealt(df: DataFrame, name: str, own: tuple[str, int], other: tuple[str, int]) -> DataFrame:
        mine = F.pmod(F.xxhash64(name), F.lit(own[1])).cast("int").alias(own[0])
        return df.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1))).alias(other[0]))

    left = dealt(docs, key, ("part", parts), ("block", blocks))
    right = dealt(asked, "query_id", ("block", blocks), ("part", parts))

    def run(_: tuple, docs: pa.Table, asked: pa.Table) -> pa.Table:
        ids, names = docs[key].to_numpy(), asked["query_id"]
        d, q = Vectors.of(docs, np.int64), Vectors.of(asked, np.int64)
        out = []
        for (part, score), (_, shown) in zip(q.products(d), q.touches(d)):
            row, col = best_of_rows(score, ids, k, shown)
            out.append((row + part.start, col, score[row, col]))
        row, col, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": names.take(pa.array(row)), "rec_no": ids[col], "score": score})

    best = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, "query_id string, rec_no long, score double")
    return _ranked(best, k)


def candidates(cut_queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, rec_no: the distinct records in the lists a query visits."""
    return cut_queries.select("query_id", "component").join(postings.select("component", "rec_no"), "component").select("query_id", "rec_no").distinct()


def score(pairs: DataFrame, queries: DataFrame, forward: DataFrame) -> DataFrame:
    """query_id, rec_no, score of each pair (query_id, rec_no) that shares a component, by the whole query and the whole record.

    Both vectors come to a pair packed, one join each, and are multiplied in Arrow batches.
    """
    asked = pack(queries, "query_id", value="qw")
    docs = pack(forward, "rec_no")
    both = pairs.join(asked.withColumnsRenamed({"cs": "qc", "vs": "qv"}), "query_id").join(docs, "rec_no").select("query_id", "rec_no", "qc", "qv", "cs", "vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (qc, qn), (dc, dn) = numbers(b.column(2), np.int32), numbers(b.column(4), np.int32)
            qv, dv = numbers(b.column(3), np.float64)[0], numbers(b.column(5), np.float64)[0]
            a, z = (np.repeat(np.arange(b.num_rows, dtype=np.int64), n) << 32 | c for c, n in ((qc, qn), (dc, dn)))
            at = np.minimum(np.searchsorted(a, z), max(len(a) - 1, 0))
            same = np.flatnonzero(a[at] == z) if len(a) else np.zeros(0, int)
            of = z[same] >> 32
            total = np.bincount(of, weights=qv[at[same]] * dv[same], minlength=b.num_rows)
            met = np.bincount(of, minlength=b.num_rows) > 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total)], names=["query_id", "rec_no", "score"]).filter(pa.array(met))

    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return both.mapInArrow(run, f"query_id {types['query_id']}, rec_no long, score double")


def lists_of(postings: DataFrame, forward: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """component, block, rec_no, cs, vs: the posting lists with the whole vectors of their records, and with codes also a row
    for each block's summary (without rec_no). This is the layout an index is stored in: a search reads the lists it visits."""
    block = F.col("block") if "block" in postings.columns else F.lit(0).alias("block")
    inside = postings.select("component", block, "rec_no").join(pack(forward, "rec_no"), "rec_no").select("component", "block", "rec_no", "cs", "vs")
    if codes is None:
        return inside
    values = codes.select("component", "block", "c", (F.col("low") + F.col("code") * F.col("step")).alias("w"))
    short = pack(values, "block", "c", by=("component",)).select("component", "block", F.lit(None).cast("long").alias("rec_no"), "cs", "vs")
    return inside.unionByName(short)


def _visit(lists: DataFrame, visits: DataFrame, queries: DataFrame, cell, spec: str, block: int = 4096) -> DataFrame:
    """cell(list, visitors) for each list and the queries that visit it, at most about block of them at a time: a list that very many
    queries visit is given to several tasks. lists: as lists_of gives them; visits: query_id, component and others."""
    asked = visits.join(pack(queries, "query_id", value="qw").withColumnsRenamed({"cs": "qc", "vs": "qv"}), "query_id")
    salts = visits.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("salts"))
    left = lists.join(salts, "component").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    right = asked.join(salts, "component").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int")).drop("salts")

    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return cell(left, right.rename_columns([{"qc": "cs", "qv": "vs"}.get(c, c) for c in right.column_names]))

    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))  # both may come from one table
    return left.groupBy("component", "salt").cogroup(right.groupBy("component", "salt")).applyInArrow(run, spec)


def _found(query_ids: pa.ChunkedArray, ids: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], **others: np.ndarray) -> pa.Table:
    row, col, score = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pa.table({"query_id": query_ids.take(pa.array(row.astype(np.int64))), "rec_no": ids[col], "score": score, **others})


#: Pairs that are scored one by one, records and visits of a list that goes to a task with others, and queries that visit a list in one task.
_FEW, _TOGETHER, _VISITORS = 512, 4096, 4096


def candidate_topk(queries: DataFrame, postings: DataFrame, forward: DataFrame, k: int = 10, cut: int = 10) -> DataFrame:
    """The k best of all records in the lists of a query's cut heaviest components, without skipping.

    A list meets the queries that visit it in one task, which scores its records and hands on the k best of each query; the k
    best of all lists are among these. So neither pairs nor vectors of single pairs are shuffled.
    """
    _check_k(k)

    def run(_: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        order, visits = (np.argsort(x["component"].to_numpy(), kind="stable") for x in (held, asked))
        ids, d, q = held["rec_no"].to_numpy()[order], Vectors.of(held).take(order), Vectors.of(asked).take(visits)
        of, wanted = held["component"].to_numpy()[order], asked["component"].to_numpy()[visits]
        lo, hi = np.searchsorted(of, wanted, "left"), np.searchsorted(of, wanted, "right")
        starts = np.flatnonzero(np.diff(wanted, prepend=-1))
        ends = np.append(starts[1:], len(wanted))
        few = np.zeros(len(wanted), bool)  # visits of lists so short that they are scored pair by pair
        rows = []
        for a, z in zip(starts, ends):
            if (z - a) * (hi[a] - lo[a]) <= _FEW:
                few[a:z] = True
            else:
                for row, col, score in q.take(np.arange(a, z)).best(d.take(np.arange(lo[a], hi[a])), ids[lo[a] : hi[a]], k):
                    rows.append((row + a, col + lo[a], score))
        few = np.flatnonzero(few)
        pairs = np.cumsum((hi - lo)[few]) >> 18
        for some in np.split(few, np.flatnonzero(np.diff(pairs)) + 1) if len(few) else []:
            size = (hi - lo)[some]
            row = np.repeat(some, size)
            col = np.repeat(lo[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            score = q.dots(row, d, col)
            order = np.lexsort((ids[col], -score, row))
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]  # row ascends, before and after it is ordered
            rows.append((row[order], col[order], score[order]))
        return _found(asked["query_id"].take(pa.array(visits)), ids, rows)

    # lists that meet few queries go to tasks together
    visits = query_cut(queries, cut).select("query_id", "component")
    lengths = postings.groupBy("component").agg(F.count(F.lit(1)).alias("len"))
    n, parts = F.col("n"), 8 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = -1 - F.pmod(F.xxhash64("component"), F.lit(parts)).cast("int")
    dealt = visits.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(lengths, "component")
    dealt = dealt.select("component", F.when((F.col("len") + n <= _TOGETHER), shared).otherwise(F.col("component")).alias("list"), F.ceil(n / F.lit(_VISITORS)).cast("int").alias("salts"))
    left = postings.select("component", "rec_no").join(dealt, "component").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    left = left.join(pack(forward, "rec_no"), "rec_no")
    right = visits.join(dealt, "component").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int")).drop("salts")
    right = right.join(pack(queries, "query_id", value="qw"), "query_id")
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))  # both may come from one table
    spec = f"query_id {queries.schema['query_id'].dataType.simpleString()}, rec_no long, score double"
    best = left.groupBy("list", "salt").cogroup(right.groupBy("list", "salt")).applyInArrow(run, spec)
    # a record found in several lists has one score in all of them
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rec_no"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"]).select("query_id", "rec_no", "score", "rank")


def pruned_topk(
    queries: DataFrame, lists: DataFrame, k: int = 10, cut: int = 10, heap_factor: float = 0.7, first_sorted: bool = True
) -> DataFrame:
    """query_id, rec_no, score, rank, and n_scored and n_inside of its query: a search that saves the work it skips, in two rounds.

    lists: as lists_of gives them, with summaries. In the first round a query visits the list of its heaviest component: the
    blocks with the highest estimates (the first ones, unless first_sorted) are scored until k records are, then those
    of the others whose estimate reaches heap_factor times the k-th score. In the second round it visits the other lists
    with the k-th score of the first, and no block below heap_factor times it is scored. A block that a sequential search
    with a rising threshold visits is visited here too, unless the first list has fewer than k records,
    so results are no worse; n_scored of the n_inside records in the lists (each as often as it is there) were scored.
    """
    _check_k(k)

    def cell(held: pa.Table, asked: pa.Table) -> pa.Table:
        records = np.flatnonzero(np.asarray(held["rec_no"].is_valid()))
        short = np.flatnonzero(~np.asarray(held["rec_no"].is_valid()))
        ids, block = held["rec_no"].take(pa.array(records)).to_numpy(), held["block"].to_numpy()
        if not len(ids):
            return _found(asked["query_id"], ids, [], n_scored=np.zeros(0, int), n_inside=np.zeros(0, int))
        everything, q = Vectors.of(held), Vectors.of(asked)
        known, of = np.unique(block[records], return_inverse=True)
        size = np.bincount(of, minlength=len(known))
        order = np.argsort(of, kind="stable")
        starts = np.append(0, np.cumsum(size))
        d = everything.take(records[order])
        ids = ids[order]
        names, local = np.unique(d.components, return_inverse=True)
        floor, first = asked["floor"].to_numpy(zero_copy_only=False), asked["list_rank"].to_numpy() == 1
        rows, scored = [], np.zeros(len(q), np.int64)
        at_short = np.searchsorted(known, block[short])
        for part, product in q.products(everything.take(short)):
            estimate = np.zeros((part.stop - part.start, len(known)))
            estimate[:, at_short] = product
            for i in range(part.start, part.stop):
                est = estimate[i - part.start]
                dense = np.zeros(len(names))
                c, v = q.components[q.starts[i] : q.starts[i + 1]], q.values[q.starts[i] : q.starts[i + 1]]
                where = np.minimum(np.searchsorted(names, c), len(names) - 1)
                dense[where[names[where] == c]] = v[names[where] == c]

                def scores(blocks: np.ndarray, dense: np.ndarray = dense) -> tuple[np.ndarray, np.ndarray]:
                    n = size[blocks]
                    recs = np.repeat(starts[blocks] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    n = d.starts[recs + 1] - d.starts[recs]
                    ends = np.cumsum(n)
                    at = np.repeat(d.starts[recs] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
                    return recs, np.add.reduceat(dense[local[at]] * d.values[at], ends - n) if len(recs) else np.zeros(0)

                todo = np.arange(len(known))
                recs, score, least = np.zeros(0, int), np.zeros(0), floor[i]
                if first[i]:
                    todo = np.argsort(-est, kind="stable") if first_sorted else todo
                    enough = int(np.searchsorted(np.cumsum(size[todo]), k)) + 1
                    recs, score = scores(todo[:enough])
                    todo = todo[enough:]
                    least = -np.partition(-score, k - 1)[k - 1] if len(score) >= k else -np.inf
                if len(todo):
                    more = scores(todo if np.isneginf(least) else todo[est[todo] >= heap_factor * least])
                    recs, score = np.append(recs, more[0]), np.append(score, more[1])
                scored[i] = len(recs)
                best = np.lexsort((ids[recs], -score))[:k]
                rows.append((np.full(max(len(best), 1), i), recs[best] if len(best) else np.array([0]), score[best] if len(best) else np.array([-np.inf])))
        inside = len(ids)
        which = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, int)
        new = np.diff(which, prepend=-1) != 0  # counts stand in the first row of a query and list
        return _found(asked["query_id"], ids, rows, n_scored=np.where(new, scored[which], 0), n_inside=np.where(new, inside, 0))

    spec = f"query_id {queries.schema['query_id'].dataType.simpleString()}, rec_no long, score double, n_scored long, n_inside long"
    visits = query_cut(queries, cut).select("query_id", "component", "list_rank")
    none = F.lit(float("-inf"))
    one = written(_visit(lists, visits.where("list_rank = 1").withColumn("floor", none), queries, cell, spec), "first")
    kth = top_by(one.where(F.col("score") > none), ["query_id"], [F.desc("score"), "rec_no"], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = visits.where("list_rank > 1").join(kth, "query_id", "left").withColumn("floor", F.coalesce("kth", none)).drop("kth")
    every = written(one.unionByName(_visit(lists, rest, queries, cell, spec)), "visited")
    counts = every.groupBy("query_id").agg(F.sum("n_scored").alias("n_scored"), F.sum("n_inside").alias("n_inside"))
    hits = every.where(F.col("score") > none).select("query_id", "rec_no", "score").distinct()
    return _ranked(hits, k).join(counts, "query_id")


def summarised_lists(postings: DataFrame, forward: DataFrame, energy: float = 0.4) -> DataFrame:
    """lists_of with the summaries that quantise_summaries(summary_energy(block_max(postings, forward), energy)) gives: each list is summed
    up in one task, so that no entry of a vector is shuffled by itself."""

    def run(held: pa.Table) -> pa.Table:
        block, d = held["block"].to_numpy(), Vectors.of(held)
        of = np.repeat(block, np.diff(d.starts))
        order = np.lexsort((-d.values, d.components, of))
        of, c, w = of[order], d.components[order], d.values[order]
        largest = np.append(True, (of[1:] != of[:-1]) | (c[1:] != c[:-1])) if len(of) else np.zeros(0, bool)
        of, c, w = of[largest], c[largest], w[largest]
        order = np.lexsort((c, -w, of))
        of, c, w = of[order], c[order], w[order]
        known, starts = np.unique(of, return_index=True)
        cs, vs = [], []
        for a, z in zip(starts, np.append(starts[1:], len(of))):
            total = np.cumsum(w[a:z])
            before = np.append(0.0, total[:-1])
            keep = np.flatnonzero((before == 0) | (before < total[-1] * energy))
            short = w[a:z][keep]
            low, step = short.min(), (short.max() - short.min()) / 255.0
            code = np.floor((short - low) / step + 0.5) if step else np.zeros(len(short))
            by = np.argsort(c[a:z][keep])
            cs.append(c[a:z][keep][by])
            vs.append((low + code * step)[by])
        sizes = np.array([len(x) for x in cs], np.int64)
        flat = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((cs, np.int32), (vs, np.float64))]
        component = pa.array(np.full(len(known), held["component"][0].as_py(), np.int32))
        short = pa.table({"component": component, "block": known.astype(np.int32), "rec_no": pa.nulls(len(known), pa.int64()), "cs": binary(flat[0], sizes), "vs": binary(flat[1], sizes)})
        return pa.concat_tables([held.cast(short.schema), short])

    return lists_of(postings, forward).groupBy("component").applyInArrow(run, "component int, block int, rec_no long, cs binary, vs binary")


def _folded(
    k: int, factor: float, est: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: np.ndarray, s: np.ndarray, r: np.ndarray, heap: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray, int]:
    """The heap (scores and records, the best first) and how many blocks were skipped, after the blocks were visited in their order. A block
    has its estimate, the hits lo to hi of s and r, and their largest score; between two blocks that change the heap the threshold stays."""
    hs, hr = heap
    at, skipped = 0, 0
    while at < len(est):
        if len(hs) < k:
            found = np.flatnonzero(hi[at:] > lo[at:])[:1]
        else:
            skip = est[at:] < factor * hs[k - 1]
            found = np.flatnonzero(~skip & (top[at:] >= hs[k - 1]))[:1]
            skipped += int(np.count_nonzero(skip[: found[0]] if len(found) else skip))
        if not len(found):
            break
        at += int(found[0])
        score, rec = np.append(hs, s[lo[at] : hi[at]]), np.append(hr, r[lo[at] : hi[at]])
        order = np.lexsort((rec, -score))
        score, rec = score[order], rec[order]
        new = np.append(True, (rec[1:] != rec[:-1]) | (score[1:] != score[:-1]))
        hs, hr = score[new][:k], rec[new][:k]
        at += 1
    return hs, hr, skipped


_VISIT = "list_rank int, n_skipped long, est binary, sizes binary, s binary, r binary"


def _blocks(est: pa.Array, sizes: pa.Array, s: pa.Array, r: pa.Array) -> Iterator[tuple]:
    """est, lo, hi, top, s, r for _folded, of each row of blocks as _VISIT has them."""
    columns = [numbers(x, kind) for x, kind in ((est, np.float64), (sizes, np.int32), (s, np.float64), (r, np.int64))]
    ends = [np.append(0, np.cumsum(n)) for _, n in columns]
    for i in range(len(est)):
        e, n, score, rec = (flat[end[i] : end[i + 1]] for (flat, _), end in zip(columns, ends))
        hi = np.cumsum(n)
        top = np.full(len(e), -np.inf)
        if len(score):
            top[n > 0] = np.maximum.reduceat(score, (hi - n)[n > 0])
        yield e, hi - n, hi, top, score, rec


_NO_HITS = np.zeros(0), np.zeros(0, np.int64)


def skipping_topk(
    queries: DataFrame, blocks: DataFrame, codes: DataFrame, forward: DataFrame, k: int = 10, cut: int = 10, heap_factor: float = 0.9, first_sorted: bool = True
) -> DataFrame:
    """query_id, rec_no, score, rank, and n_skipped of its query: a block is skipped if k hits are known and its estimate is
    below heap_factor times the k-th score; blocks are visited list by list, by number, those of the first list
    by estimate descending if first_sorted. A query without any hit has no row.

    With factor 0 and no negative weight (so none in codes either, which sum blocks up) no estimate is below the threshold: no block can
    be skipped, and all records of the blocks are searched as candidate_topk does.
    """
    _check_k(k)
    if heap_factor == 0 and not any((df.agg(F.min(c)).first()[0] or 0) < 0 for df, c in ((queries, "qw"), (forward, "w"))):
        return candidate_topk(queries, blocks, forward, k, cut).withColumn("n_skipped", F.lit(0))
    return skipping_lists(queries, written(lists_of(blocks, forward, codes), "lists"), k, cut, heap_factor, first_sorted)


def skipping_lists(queries: DataFrame, lists: DataFrame, k: int = 10, cut: int = 10, heap_factor: float = 0.9, first_sorted: bool = True) -> DataFrame:
    """skipping_topk over lists as lists_of gives them, with summaries; they are read several times.

    The threshold moves with each block, yet few blocks move it. A query's first list of at least k records is folded where it is scored, after
    the shorter ones before it; the k-th score then known is a floor for the others. Of these a task counts the blocks below the floor's
    threshold, which are skipped at any rate, and hands on the estimates of the rest, each with the hits (k at most) that reach the
    floor. These are folded by query, in their order, so the result is that of the sequence; pairs and vectors aren't shuffled.
    """
    _check_k(k)
    kind = queries.schema["query_id"].dataType.simpleString()

    def cell(held: pa.Table, asked: pa.Table) -> pa.Table:
        is_record = np.asarray(held["rec_no"].is_valid())
        records, short = np.flatnonzero(is_record), np.flatnonzero(~is_record)
        everything, q, block = Vectors.of(held), Vectors.of(asked), held["block"].to_numpy()
        known, of = np.unique(block[records], return_inverse=True)
        order = np.lexsort((records, of))
        records, of = records[order], of[order]
        ids, d = held["rec_no"].take(pa.array(records)).to_numpy(), everything.take(records)
        starts = np.searchsorted(of, np.arange(len(known)))
        ends = np.append(starts[1:], len(of))
        summed = short[np.isin(block[short], known)]
        at_short, sums = np.searchsorted(known, block[summed]), everything.take(summed)
        own = np.bincount(d.rows()[d.components == held["component"][0].as_py()], minlength=len(ids)) > 0
        foreign = np.flatnonzero(~own)  # records whose vector lacks the list's component may share nothing with a query
        list_rank, floor = asked["list_rank"].to_numpy(), asked["floor"].to_numpy(zero_copy_only=False)
        by_est = (list_rank == 1) & first_sorted
        priors = _blocks(*(asked[c].combine_chunks() for c in ("pe", "pn", "ps", "pr"))) if "pe" in asked.column_names else None
        out: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in (np.float64, np.int64, np.int32, np.int64, np.float64, np.int64)]
        n_skipped = np.zeros(len(q), np.int64)

        def give(row: np.ndarray, est: np.ndarray, sizes: np.ndarray, hit_row: np.ndarray, s: np.ndarray, r: np.ndarray) -> None:
            for x, y in zip(out, (est, row, sizes.astype(np.int32), hit_row, s, r)):
                x.append(y)

        for part, score in q.products(d) if len(ids) else []:
            rows = np.arange(part.start, part.stop)
            mine = q.take(rows)
            est = np.zeros((len(rows), len(known)))
            if len(summed):
                est[:, at_short] = np.concatenate([x for _, x in mine.products(sums)])
            if len(foreign):
                touched = np.concatenate([x for _, x in mine.touches(d.take(foreign))])
                score[:, foreign] = np.where(touched, score[:, foreign], -np.inf)
            top = np.maximum.reduceat(score, starts, axis=1)
            est[np.isneginf(top)] = np.inf  # no block without a hit is visited
            if priors is not None:
                for i, prior in zip(rows, priors):
                    j = i - part.start
                    heap = _folded(k, heap_factor, *prior, _NO_HITS)
                    visit = np.argsort(-est[j], kind="stable") if by_est[i] else np.arange(len(known))
                    visit = visit[~np.isneginf(top[j, visit])]
                    shown = score[j]
                    lo, hi = starts[visit], ends[visit]
                    if len(foreign):
                        real = np.flatnonzero(~np.isneginf(shown))
                        lo, hi = np.searchsorted(real, lo), np.searchsorted(real, hi)
                        hs, hr, n = _folded(k, heap_factor, est[j, visit], lo, hi, top[j, visit], shown[real], ids[real], heap[:2])
                    else:
                        hs, hr, n = _folded(k, heap_factor, est[j, visit], lo, hi, top[j, visit], shown, ids, heap[:2])
                    n_skipped[i] = heap[2] + n
                    give(np.array([i]), np.array([np.inf]), np.array([len(hs)]), np.full(len(hs), i), hs, hr)
                continue
            least = floor[rows]
            never = np.where(np.isneginf(least) | (heap_factor < 0), -np.inf, heap_factor * np.where(np.isneginf(least), 0.0, least))
            gone = est < never[:, None]
            n_skipped[rows] = gone.sum(1)
            row, col = np.nonzero(~gone & ~np.isneginf(top) & ((heap_factor != 0) | (est < 0) | (top >= least[:, None])))
            visit = np.lexsort((col, np.where(by_est[rows[row]], -est[row, col], 0.0), row))
            row, col = row[visit], col[visit]
            item = np.full(est.shape, -1)
            item[row, col] = np.arange(len(row))
            hit, rec = np.nonzero((score >= least[:, None]) & ~np.isneginf(score))
            of_item = item[hit, of[rec]]
            hit, rec, of_item = hit[of_item >= 0], rec[of_item >= 0], of_item[of_item >= 0]
            s, r = score[hit, rec], ids[rec]
            by = np.lexsort((r, -s, of_item))
            by = by[np.arange(len(by)) - np.searchsorted(of_item[by], of_item[by]) < k]
            give(rows[row], est[row, col], np.bincount(of_item[by], minlength=len(row)), rows[hit[by]], s[by], r[by])
        est, row, sizes, hit_row, s, r = (np.concatenate(x) for x in out)
        items, hits = np.bincount(row, minlength=len(q)), np.bincount(hit_row, minlength=len(q))
        columns = {"est": binary(est, items), "sizes": binary(sizes, items), "s": binary(s, hits), "r": binary(r, hits)}
        return pa.table({"query_id": asked["query_id"], "list_rank": asked["list_rank"], "n_skipped": n_skipped, **columns})

    spec = f"query_id {kind}, {_VISIT}"
    lengths = lists.where(F.col("rec_no").isNotNull()).groupBy("component").agg(F.count(F.lit(1)).alias("len"))
    visits = query_cut(queries, cut).select("query_id", "component", "list_rank").join(lengths, "component")
    none = F.lit(float("-inf"))
    pivots = visits.where(F.col("len") >= k).groupBy("query_id").agg(F.min("list_rank").alias("pivot"))
    visits = written(visits.join(pivots, "query_id", "left"), "visits")  # read five times
    short = visits.where(F.col("len") < k).select("query_id", "component", "list_rank", none.alias("floor"))
    short = written(_visit(lists, short, queries, cell, spec), "short")  # fewer than k hits a list
    at_pivot = visits.where(F.col("list_rank") == F.col("pivot")).select("query_id", "component", "list_rank", none.alias("floor"))
    prior = short.join(at_pivot.select("query_id", F.col("list_rank").alias("pivot")), "query_id").where(F.col("list_rank") < F.col("pivot"))
    ordered = F.array_sort(F.collect_list(F.struct("list_rank", "est", "sizes", "s", "r")))
    names = dict(zip(("pe", "pn", "ps", "pr"), ("est", "sizes", "s", "r")))
    joined = {n: F.expr(f"aggregate(v, X'', (a, x) -> concat(a, x.{c}))") for n, c in names.items()}
    prior = prior.groupBy("query_id").agg(ordered.alias("v")).withColumns(joined).drop("v")
    at_pivot = at_pivot.join(prior, "query_id", "left").withColumns({n: F.coalesce(n, F.lit(b"")) for n in names})
    first = written(_visit(lists, at_pivot, queries, cell, spec), "pivots")
    kth = first.select("query_id", F.when(F.octet_length("r") == 8 * k, F.col("s")).alias("s"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            floor = [np.frombuffer(s, np.float64)[-1] if s else -np.inf for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(floor, pa.float64())], names=["query_id", "floor"])

    floors = kth.mapInArrow(last, f"query_id {kind}, floor double")
    rest = visits.where((F.col("len") >= k) & (F.col("list_rank") > F.col("pivot"))).select("query_id", "component", "list_rank").join(floors, "query_id")
    later = short.join(visits.where("list_rank = pivot").select("query_id", "pivot"), "query_id", "left").where(F.col("pivot").isNull() | (F.col("list_rank") > F.col("pivot"))).drop("pivot")
    every = first.unionByName(later).unionByName(_visit(lists, rest, queries, cell, spec))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            flat, ends = v.flatten(), v.offsets.to_numpy() - v.offsets[0].as_py()
            fields = dict(zip([flat.type.field(i).name for i in range(flat.type.num_fields)], flat.flatten()))
            counted, each = fields["n_skipped"].to_numpy(), _blocks(*(fields[c] for c in ("est", "sizes", "s", "r")))
            of, s, r, skipped = [], [], [], []
            for i in range(b.num_rows):
                heap, n = _NO_HITS, int(counted[ends[i] : ends[i + 1]].sum())
                for _ in range(ends[i], ends[i + 1]):
                    *heap, more = _folded(k, heap_factor, *next(each), tuple(heap))
                    n += more
                of.append(len(heap[0]))
                s.append(heap[0])
                r.append(heap[1])
                skipped.append(n)
            of = np.array(of, np.int64)
            row = np.repeat(np.arange(b.num_rows), of)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(of) - of, of) + 1
            columns = [b.column(0).take(pa.array(row)), np.concatenate([_NO_HITS[1], *r]), np.concatenate([_NO_HITS[0], *s]), rank.astype(np.int32), np.array(skipped, np.int32)[row]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["query_id", "rec_no", "score", "rank", "n_skipped"])

    ordered = F.array_sort(F.collect_list(F.struct("list_rank", "n_skipped", "est", "sizes", "s", "r")))
    return every.groupBy("query_id").agg(ordered.alias("v")).mapInArrow(fold, f"query_id {kind}, rec_no long, score double, rank int, n_skipped int")


def refine(hits: DataFrame, graph: DataFrame, queries: DataFrame, forward: DataFrame, k: int = 10, n_knn: int = 10) -> DataFrame:
    """hits with the first n_knn neighbours (graph: rec_no, rank, neighbour) of each scored as well: the k best of both, one hop."""
    hits = written(hits, "hits")  # read three times, k rows a query
    near = hits.select("query_id", "rec_no").join(graph.where(F.col("rank") <= n_knn), "rec_no").select("query_id", F.col("neighbour").alias("rec_no")).distinct()
    fresh = near.join(hits.select("query_id", "rec_no"), ["query_id", "rec_no"], "left_anti")
    both = hits.select("query_id", "rec_no", "score").unionByName(score(fresh, queries, forward))
    return _ranked(both, k)


def remap(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, score, rank: records by their text id (docs: rec_no, doc_id); without one, the number as text."""
    return hits.join(docs.select("rec_no", "doc_id"), "rec_no", "left").select("query_id", F.coalesce("doc_id", F.col("rec_no").cast("string")).alias("doc_id"), "score", "rank")


def with_text(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits with content. Records that share an id have the content of the first of them (docs: rec_no, doc_id, content)."""
    named = hits.join(docs.select("rec_no", "doc_id"), "rec_no", "left")
    wanted = named.select("doc_id").distinct()
    first = docs.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("content", "rec_no").alias("content"))  # contents of the hits' ids only
    return named.join(first, "doc_id", "left").select(*hits.columns, "doc_id", "content")


def rag_prompts(hits: DataFrame, docs: DataFrame, queries: DataFrame, query_key: str = "id", query_text: str = "content") -> DataFrame:
    """query_id, prompt: the question and its numbered passages, best first. Hits without text are left out of the numbering."""
    text = with_text(hits, docs).where(F.col("content").isNotNull())
    numbered = text.withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    line = F.concat(F.lit("["), F.col("no").cast("string"), F.lit("] "), F.col("content"))
    passages = numbered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))).alias("p"))
    asked = queries.select(F.col(query_key).alias("query_id"), F.coalesce(query_text, F.lit("")).alias("question"))
    joined = F.array_join(F.transform("p", lambda x: x["line"]), "\n")
    return asked.join(passages, "query_id").select("query_id", F.concat(F.lit("Question: "), F.col("question"), F.lit("\nPassages:\n"), joined).alias("prompt"))
