import random

import numpy as np
import pytest

from lexivane.llm import hilbert_knn as H
from lexivane.llm.term_counts import mark_terms, term_counts

ENTRY = "entry_id long, rec_no long, token string, weight float, batch_no long, salt int, any boolean"


def test_term_counts_against_sets(spark):
    rng = random.Random(4)
    rows = []
    for e in range(1200):
        row = (e, rng.choice([None, *range(25)]), rng.choice(["the", "the", "of", "", None, *map(str, range(20))]), 1.0)
        rows += [(*row, b, 0, None) for b in range(1 + (rng.random() < 0.3))]
    got = {r.token: (r.n_entries, r.n_records) for r in term_counts(spark.createDataFrame(rows, ENTRY), 5).collect()}
    want = {}
    for e, r, t, *_ in rows:
        es, rs = want.setdefault(t, (set(), set()))
        es.add((e, r))
        if r is not None:
            rs.add(r)
    assert got == {t: (len(es), len(rs)) for t, (es, rs) in want.items()}


def test_marks(spark):
    rows = [(i, i % 8, "common", 1.0, 1, 0, None) for i in range(24)] + [(100, 1, "rare", 1.0, 1, 0, None), (101, 2, "rare", 1.0, 1, 0, None)]
    rows += [(200 + i, i, "three", 1.0, 1, 0, None) for i in range(3)] + [(300 + i, i, "two of eight", 1.0, 1, 0, None) for i in range(2)]
    rows += [(400, 9, None, 1.0, 1, 0, None), (401, 9, "", 1.0, 1, 0, None), (402, 10, None, None, 1, 0, None), (403, 11, None, None, 1, 0, None), (404, 12, None, None, 1, 0, None)]
    got = {r.token: (r.mark, r.all_records) for r in mark_terms(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got["common"] == ("common", 12) and got["rare"][0] == "rare" and got["two of eight"][0] == "rare"
    assert got["three"][0] is None and got[None][0] is None and got[""][0] is None
    assert mark_terms(spark.createDataFrame([], ENTRY)).count() == 0


@pytest.mark.parametrize(("d", "bits"), [(2, 5), (3, 3), (4, 2)])
def test_hilbert_order_visits_every_cell_by_single_steps(d, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
    place = H.hilbert_index(cells, bits)
    assert sorted(place) == list(range(side**d))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


RECORD = "rec_no long, vector map<string,float>, content string, tokens int, rep string"


def exact(vectors, k, least):
    out = {}
    for a, v in vectors.items():
        scores = [(-sum(w * u.get(t, 0.0) for t, w in v.items()), b) for b, u in vectors.items() if b != a]
        best = sorted(s for s in scores if -s[0] >= least)[:k]
        if best:
            out[a] = [(b, -s) for s, b in best]
    return out


def test_partners_against_brute_force(spark):
    rng = random.Random(8)
    topics = [[f"t{i}_{j}" for j in range(8)] for i in range(40)]
    vectors = {}
    for r in range(500):
        own = rng.sample(rng.choice(topics), 4)
        vectors[r] = {t: rng.randint(64, 192) / 64 for t in own} | {c: rng.randint(1, 16) / 64 for c in rng.sample(["the", "of", "a", "is", "and", "in"], 3)}
    for r in range(500, 520):
        vectors[r] = dict(vectors[r - 500])
    for r in range(520, 700):  # a group of copies
        vectors[r] = dict(vectors[3])
    rows = [(r, v, None, None, None) for r, v in vectors.items()]
    rows += [(1000, None, None, None, None), (1001, {}, None, None, None), (1002, {"t0_0": None}, None, None, None)]
    lists = H.best_partners(spark.createDataFrame(rows, RECORD))
    got = {r.rec_no: [(x.other, x.score) for x in r.partners] for r in lists.collect()}
    want = exact(vectors, 5, 8.0)
    assert not {1000, 1001, 1002} & set(got)
    found = sum(len(set(want[r]) & set(got.get(r, []))) for r in want)
    assert found >= 0.97 * sum(map(len, want.values()))
    for r, own in got.items():
        assert own == sorted(own, key=lambda x: (-x[1], x[0])) and len(own) <= 5 and r not in [x for x, _ in own]
        assert all(s == sum(w * vectors[b].get(t, 0.0) for t, w in vectors[r].items()) >= 8.0 for b, s in own)
    for r in range(520, 700):  # ties within the copies go to the lowest records, as in the exact lists
        assert got[r] == want[r]
    pairs = {tuple(x) for x in H.partner_pairs(lists).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, own in got.items() for b, _ in own}


def test_no_partners(spark):
    assert H.best_partners(spark.createDataFrame([], RECORD)).count() == 0
    one = spark.createDataFrame([(1, {"a": 9.0}, None, None, None), (2, {"b": 9.0}, None, None, None)], RECORD)
    assert H.best_partners(one).count() == 0
    with pytest.raises(ValueError):
        H.best_partners(one, min_score=0.0)
    with pytest.raises(Exception, match="must not be negative"):
        H.best_partners(spark.createDataFrame([(1, {"a": -9.0}, None, None, None)], RECORD)).collect()


def test_a_very_long_vector(spark):
    long = {f"x{i}": 0.25 for i in range(20_000)}
    rows = [(1, long, None, None, None), (2, dict(long), None, None, None), (3, {**long, "y": 1.0}, None, None, None)]
    got = {r.rec_no: [x.other for x in r.partners] for r in H.best_partners(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {1: [2, 3], 2: [1, 3], 3: [1, 2]}


def test_a_crowd_of_near_copies(spark):
    rng = random.Random(3)
    base = {f"b{i}": rng.randint(32, 128) for i in range(20)}
    vectors = {r: {t: w * rng.randint(58, 70) / 4096 for t, w in base.items()} for r in range(900)}
    for r in range(900, 1200):
        vectors[r] = {f"t{rng.randrange(3000)}": rng.randint(64, 192) / 64 for _ in range(6)}
    rows = [(r, v, None, None, None) for r, v in vectors.items()]
    got = {r.rec_no: {x.other for x in r.partners} for r in H.best_partners(spark.createDataFrame(rows, RECORD)).collect()}
    want = exact(vectors, 5, 8.0)
    assert sum(map(len, want.values())) >= 4500
    assert sum(len({b for b, _ in own} & got.get(r, set())) for r, own in want.items()) >= 0.99 * sum(map(len, want.values()))


def test_lists_do_not_depend_on_the_partitions(spark):
    """Windows go across the borders of partitions, also of those with fewer points than a window."""
    rng = random.Random(21)
    rows = [(r, {f"t{rng.randrange(60)}": rng.randint(64, 192) / 64 for _ in range(6)}) for r in range(700)]
    df = spark.createDataFrame(rows, "rec_no long, vector map<string,float>")
    curves = H.Curves(blocks=16, window=8)
    vectors = H.vector_classes(df, "rec_no", "vector")
    top = H._largest_norms(vectors, curves)
    seen = []
    for parts in (1, 3, 40, 400):
        bounds = H._bounds(vectors, "rec_no", curves, top, 8.0, parts)
        assert parts == 1 or len(bounds[0]) > parts / 2
        ordered = H._points(vectors, "rec_no", curves, top, 8.0, bounds).repartitionById(parts, "part").sortWithinPartitions("part", "spot", "rec_no")
        lists = {}
        for r in H._windows(ordered, curves).collect():
            for other, part in np.frombuffer(bytes(r.shared), H.SHARED):
                lists.setdefault(r.own, []).append((int(other), float(part)))
        seen.append({own: sorted(x) for own, x in lists.items()})
    assert len(seen[0]) > 500 and all(x == seen[0] for x in seen)


def test_windows_hold_what_the_bound_promises(spark):
    """With windows over all points no pair that reaches the score is missed before lists are cut."""
    rng = random.Random(22)
    vectors = {r: {f"t{rng.randrange(200)}": rng.randint(32, 192) / 64 for _ in range(12)} for r in range(100)}
    df = spark.createDataFrame(list(vectors.items()), "rec_no long, vector map<string,float>")
    curves = H.Curves(blocks=400, window=127, kept=1000)
    packed = H.vector_classes(df, "rec_no", "vector")
    points = H._points(packed, "rec_no", curves, H._largest_norms(packed, curves), 8.0)
    pairs = H._likely(H._windows(points.repartitionById(1, "part").sortWithinPartitions("part", "spot", "rec_no"), curves), 1000)
    want = {(a, b) for a, own in exact(vectors, 1000, 8.0).items() for b, _ in own if a < b}
    assert want and want <= {tuple(r) for r in pairs.collect()}


def test_exact_lists_and_recall(spark):
    rng = random.Random(23)
    vectors = {r: {f"t{rng.randrange(40)}": rng.randint(64, 192) / 64 for _ in range(6)} for r in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "rec_no long, vector map<string,float>")
    lists = H.exact_partners(df, df.where("rec_no % 50 = 0"))
    got = {}
    for r in lists.orderBy("rec_no", "rank").collect():
        got.setdefault(r.rec_no, []).append((r.other, r.score))
    assert got == {r: own for r, own in exact(vectors, 5, 8.0).items() if r % 50 == 0}
    found = H.recall(H.best_partners(df, curves=H.Curves(kept=64)), lists).first()  # 40 tokens: any two records share some
    assert found.n_exact == sum(map(len, got.values())) and found.n_found >= 0.9 * found.n_exact
