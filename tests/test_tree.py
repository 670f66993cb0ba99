import random

import pytest
from pyspark.sql import functions as F

from lexivane.functions.quantise import float_place, place_float
from lexivane.operators import tree
from lexivane.operators.tree import chunks_of, heavy_postings, tree_aggregate, unique_entries

SPEC = "entry_id long, rec_no long, token string, weight float, batch_no long, segment int"


def expected(rows):
    entries = {}
    for e, r, t, w, b, _ in rows:
        if b is not None:
            key = (e, r, t, None if w != w else w)  # NaN counts as no weight
            entries[key] = min(entries.get(key, b), b)
    batches = {}
    for (_, r, t, w), b in entries.items():
        batches.setdefault(b, {}).setdefault(t, []).append((w, r))
    out = set()
    for b, lists in batches.items():
        total = sum(map(len, lists.values()))
        for t, own in lists.items():
            if t and 50 * len(own) >= total:
                known = [(-w, r) for w, r in own if w is not None and r is not None]
                out.add((b, t, min(known)[1] if known else None))
    return out


def random_rows(n, seed):
    rng = random.Random(seed)
    tokens = ["the"] * 40 + ["of"] * 20 + ["", None] + [f"t{i}" for i in range(60)]
    rows = []
    for e in range(n):
        row = (e, rng.choice([None, *range(30)]), rng.choice(tokens), rng.choice([float("nan"), 0.5, 1.0, 1.5] if e % 2 else [None, 0.5, 1.0, 1.5]), rng.randint(1, 4), 0)
        rows.append(row)
        if rng.random() < 0.2:
            rows.append((*row[:4], rng.randint(1, 5), 1))
    return rows


@pytest.mark.parametrize("fan_in", [2, 16])
def test_heavy_postings_against_brute_force(spark, fan_in):
    rows = random_rows(1500, 3)
    rows.append((None, 1, "the", 1.0, None, 0))
    got = heavy_postings(spark.createDataFrame(rows, SPEC).repartition(7), fan_in=fan_in)
    assert {(r.batch_no, r.token, r.rec_no) for r in got.collect()} == expected(rows)


def test_ties_go_to_the_lowest_record(spark):
    rows = [(1, 9, "a", 1.0, 1, 0), (2, 3, "a", 1.0, 1, 0), (3, 5, "a", 0.5, 1, 0)]
    assert [r.rec_no for r in heavy_postings(spark.createDataFrame(rows, SPEC)).collect()] == [3]


def test_an_entry_counts_in_its_lowest_batch(spark):
    rows = [(1, 1, "a", 1.0, 2, 0), (1, 1, "a", 1.0, 1, 0)]
    assert [(r.batch_no, r.n_entries) for r in heavy_postings(spark.createDataFrame(rows, SPEC)).collect()] == [(1, 1)]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], SPEC + ", best int, n_entries int, named string, __tree_slot int, chunk int, top int")
    assert heavy_postings(df).count() == 0
    one = spark.createDataFrame([(1, 1, "a", 1.0, 1, 0, 7, 8, "x", 9, 10, 11)], df.schema)
    assert heavy_postings(one).count() == 1


def test_floats_are_ordered_by_their_places(spark):
    rng = random.Random(5)
    values = [0.0, 1.0, -1.0, 1e-45, -1e-45, 1.1754944e-38, 1.1754942e-38, 3.4028235e38, float("inf"), 0.1, 2.0, 0.99999994, 1.0000001, 16777216.0]
    values += [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-149, 128) for _ in range(500)] + [2.0**e for e in range(-149, 128)]
    rows = spark.createDataFrame([(v,) for v in values], "v float").withColumn("p", float_place(F.col("v"))).withColumn("back", place_float(F.col("p"))).collect()
    assert all(r.back == r.v for r in rows)
    assert [r.v for r in sorted(rows, key=lambda r: r.p)] == sorted(r.v for r in rows)


@pytest.mark.parametrize("rec", [0, 1, -5, 2**63 - 1, -(2**63) + 1, 2**62 + 1])
def test_extreme_records_and_weights(spark, rec):
    for weight in (0.0, 1e-45, 3.4028235e38, float("inf"), -2.5):
        rows = [(1, rec, "a", weight, 1, 0), (2, rec + 1 if rec < 2**63 - 1 else rec, "a", weight, 1, 0), (3, 4, "a", None, 1, 0)]
        assert [(r.rec_no, r.weight) for r in heavy_postings(spark.createDataFrame(rows, SPEC)).collect()] == [(rec, pytest.approx(weight, rel=1e-7))]


def test_tree_rounds_meet_in_one_state(spark):
    df = spark.range(0, 1000, 1, 64).select((F.col("id") % 3).alias("k"), "id")
    rounds = tree_aggregate(df, ["k"], {"n": F.count("id"), "s": F.sum("id")}, {"n": F.sum("n"), "s": F.sum("s")}, F.pmod("id", F.lit(64)), 64, fan_in=3)
    want = df.groupBy("k").agg(F.count("id").alias("n"), F.sum("id").alias("s"))
    assert sorted(map(tuple, rounds.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], {"n": F.count("id")}, {"n": F.sum("n")}, F.lit(0), 1, fan_in=1)


def test_no_task_gets_more_than_fan_in_states_of_a_key(spark):
    """Counted on real entries: of every round, the states that a task receives for a key and slot."""
    fan_in, chunk_rows = 4, 200
    entries = spark.createDataFrame(random_rows(6000, 9), SPEC)
    unique = unique_entries(entries).where("batch_no is not null")
    chunk, n_chunks = chunks_of(unique, ["entry_id", "rec_no", "token", "weight"], entries.count(), chunk_rows)
    assert n_chunks > fan_in**2
    held = unique.withColumn("chunk", chunk).withColumn("task", F.spark_partition_id()).cache()
    sizes = held.groupBy("chunk").agg(F.count_distinct("task").alias("tasks"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.tasks == 1 and r.n < 2 * chunk_rows for r in sizes)  # a chunk is combined in one place, before anything is sent
    states = [(r.token, r.chunk) for r in held.select("token", "chunk").distinct().collect()]
    while len({c for _, c in states}) > 1:
        met = {}
        for token, c in states:
            met[token, c // fan_in] = met.get((token, c // fan_in), 0) + 1
        assert max(met.values()) <= fan_in
        states = list(met)
    plan = []
    unseen = tree.cut
    tree.cut = lambda df, name: plan.append(df._jdf.queryExecution().executedPlan().toString()) or unseen(df, name)
    try:
        got = heavy_postings(entries, fan_in=fan_in, chunk_rows=chunk_rows)
    finally:
        tree.cut = unseen
    rounds = len(range(0, n_chunks.bit_length() - 1, 2))
    assert plan[0].count("Exchange hashpartitioning") == rounds + 1 and "SortAggregate" not in plan[0]
    assert {(r.batch_no, r.token, r.rec_no) for r in got.collect()} == expected([tuple(r) for r in entries.collect()])
