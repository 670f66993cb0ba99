"""The registered queries of the subpackage that have SQL, and the packing's invariants, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from lexivane.llm import queries as Q
from lexivane.session import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("sparse_records", "vector_entries", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    result = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = sorted(tuple(repr(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert sorted(names) == cols and sorted(tuple(repr(r[c]) for c in cols) for r in df.collect()) == want


def test_packing_keeps_every_document_within_capacity(spark):
    rows = Q.p7_pack(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect()}
    filled, size, pieces = Counter(), Counter(), Counter()
    for r in rows:
        filled[r.container] += r["size"]
        size[r.doc_id] += r["size"]
        pieces[r.doc_id] += 1
    assert max(filled.values()) <= 2048 and all(n == max(1, -(-size[d] // 2048)) for d, n in pieces.items())
    ids = {r.doc_id: len(r.ids) for r in Q.p6_ids(spark, SF).collect()}
    assert ids == dict(size)


def test_neighbour_recall(spark):
    found = Q.p3_recall(spark, SF).first()
    assert found.n_found >= 0.9 * found.n_exact > 0
