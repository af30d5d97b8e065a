import math

import numpy as np

from stowline.llm.posting_lists import nearest
from stowline.llm.queries import QUERIES
from tests.llm.data import table_rows

SF = "/root/testdata/sf0.1"


def plain(rows, queries, k=5):
    rows = [(i, np.array(v, dtype=float)) for i, v in rows]
    out = {}
    for q, v in queries:
        v = np.array(v, dtype=float)
        scored = [(-(v @ x) / (np.linalg.norm(v) * np.linalg.norm(x)), i) for i, x in rows if i != q]
        out[q] = sorted(scored)[:k]
    return out


def by_query(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_on_whole_table(spark):
    rows = table_rows("embeddings", "vec_id, embedding", SF)
    want = plain(rows, [r for r in rows if r[0] % 50 == 0])
    got = by_query(QUERIES["op1_posting_lists"](spark, SF))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(len(v) == 5 for v in got.values())


def test_ties_copies_and_bad_vectors(spark):
    nan, inf = math.nan, math.inf
    good = [(i, [1.0, 2.0, 3.0]) for i in range(100, 140)] + [(1, [2.0, 4.0, 6.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [-1.0, -2.0, -3.0])]
    bad = [(50, None), (51, [0.0, 0.0, 0.0]), (52, [1.0, None, 2.0]), (53, [nan, 1.0, 1.0]), (54, [inf, 1.0, 1.0]), (55, [1.0]), (56, []), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<double>, u int, v string")
    got = by_query(nearest(frame, frame.where("vec_id in (100, 2, 50, 51, 55)")))
    want = plain(good, [(100, [1.0, 2.0, 3.0]), (2, [1.0, 0.0, 0.0])])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {100: [1, 101, 102, 103, 104], 2: [i for _, i in want[2]]}
    assert nearest(frame.limit(0), frame).count() == 0 and nearest(frame, frame.limit(0)).count() == 0
    few = frame.where("vec_id in (2, 3)")
    assert [r.vec_id for r in nearest(few, few.where("vec_id = 2")).collect()] == [3]
