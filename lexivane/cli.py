"""python -m lexivane.cli build|search: an index from a file of records, and ranked lists for a file of queries."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from lexivane.config import Configuration
from lexivane.index import PackedIndex, RawIndex, SparseIndex
from lexivane.operators import metrics
from lexivane.session import local_session
from lexivane.sources import records as sources


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="build and save an index")
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--binary", action="store_true", help="the input is a binary vector file")
    b.add_argument("--pruning", choices=["fixed", "global", "coi"], default="global")
    b.add_argument("--n-postings", type=int, default=6000)
    b.add_argument("--max-fraction", type=float, default=1.5)
    b.add_argument("--alpha", type=float, default=0.15)
    b.add_argument("--blocking", choices=["fixed", "kmeans"], default="kmeans")
    b.add_argument("--block-size", type=int, default=10)
    b.add_argument("--clustering", choices=["exact", "inverted", "approx"], default="approx")
    b.add_argument("--centroid-fraction", type=float, default=0.1)
    b.add_argument("--min-cluster-size", type=int, default=2)
    b.add_argument("--doc-cut", type=int, default=15)
    b.add_argument("--pruning-factor", type=float, default=0.005)
    b.add_argument("--summary-energy", type=float, default=0.5)
    b.add_argument("--value-type", choices=["f32", "f16", "bf16", "fixedu8", "fixedu16", "packed8"], default="f16")
    b.add_argument("--knn", type=int, default=0)
    b.add_argument("--knn-path")
    s = sub.add_parser("search", help="search a saved index")
    s.add_argument("--index", required=True)
    s.add_argument("--queries", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--binary", action="store_true", help="the index was built from a binary file, and so are the queries")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--query-cut", type=int, default=10)
    s.add_argument("--heap-factor", type=float, default=0.7)
    s.add_argument("--first-sorted", action="store_true")
    s.add_argument("--n-knn", type=int, default=0)
    s.add_argument("--n-queries", type=int, help="only the first so many queries")
    return out


def configuration(a: argparse.Namespace) -> Configuration:
    config = Configuration().pruned(kind=a.pruning, n_postings=a.n_postings, max_fraction=a.max_fraction, alpha=a.alpha)
    config = config.blocked(
        kind=a.blocking, block_size=a.block_size, algorithm=a.clustering, centroid_fraction=a.centroid_fraction, min_cluster_size=a.min_cluster_size, doc_cut=a.doc_cut, pruning_factor=a.pruning_factor
    )
    return config.summarized(energy=a.summary_energy).with_knn(nknn=a.knn, knn_path=a.knn_path).with_value_type(a.value_type)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = local_session(name="lexivane-cli")
    began = time.perf_counter()
    if a.command == "build":
        config = configuration(a)
        if a.binary:
            rows = sources.read_inner(spark, a.input).select(F.col("ordinal").alias("rec_no"), F.explode(F.arrays_zip("components", "vals")).alias("e"))
            index = RawIndex.build(rows.select("rec_no", F.col("e.components").alias("component"), F.col("e.vals").cast("double").alias("w")), config)
        else:
            index = (PackedIndex if a.value_type == "packed8" else SparseIndex).from_file(spark, a.input, config)
        print(f"saved {index.save(a.output)} after {time.perf_counter() - began:.1f} s")
        index.print_space_usage_byte()
        return
    if a.binary:
        index = RawIndex.load(spark, a.index)
        hits = index.batch_search_file(a.queries, a.k, a.query_cut, a.heap_factor, a.n_knn, a.first_sorted)
        asked = sources.read_inner(spark, a.queries).select(F.col("ordinal").cast("string").alias("id"))
        hits, doc = (hits.where(F.col("query_id").cast("long") < a.n_queries) if a.n_queries else hits), "rec_no"
    else:
        index = SparseIndex.load(spark, a.index)
        asked = sources.read_queries(spark, a.queries)
        asked = asked.orderBy("id").limit(a.n_queries) if a.n_queries else asked
        hits, doc = index.search_tokens(asked, a.k, a.query_cut, a.heap_factor, a.n_knn, a.first_sorted), "doc_id"
    sources.write_run(hits, a.output, doc)
    seconds, n = time.perf_counter() - began, asked.count()
    short = metrics.short_results(sources.read_run(spark, a.output), asked, a.k).count()
    print(f"{n} queries in {seconds:.1f} s, {n / seconds:.1f} a second; {short} with fewer than {a.k} results")


if __name__ == "__main__":
    main()
