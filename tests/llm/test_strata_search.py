import math
import random
import re
from collections import Counter

import duckdb
import pytest

from stowline.llm import strata_search
from stowline.llm.strata_search import ranked_search
from tests.llm.data import SF_DIR, docs_frame, table_rows

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    """All scores by the formula, one document at a time."""
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for w, c in df.items()}
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m = 25 + (75 * sum(b.values()) * n) // total
            score = sum(c * weight[w] * ((10**9 * b[w]) // (1000 * b[w] + 8 * m)) for w, c in Counter(words(text)).items() if w in b)
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def items_frame(spark, items):
    full = [(i, t, 1, "x", 2) for i, t in items]
    return spark.createDataFrame(full, "item_id long, text string, i long, w string, d int")


def test_whole_table(spark):
    from stowline.llm.queries import ORACLES, QUERIES

    want = plain(table_rows("documents", "doc_id, text"), table_rows("benchmark", "item_id, text"))
    assert rows(QUERIES["op11_strata_search"](spark, SF_DIR)) == want
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
        assert sorted(db.sql(ORACLES["op11_strata_search"]).fetchall(), key=str) == want


@pytest.mark.parametrize("seed", range(4))
def test_ties_and_small_strata(spark, seed, monkeypatch):
    monkeypatch.setattr(strata_search, "STRATUM_ROWS", 3)
    rng = random.Random(seed)
    word = lambda: rng.choice("aab cd efg hé 日本 0x B-C d.e".split())
    docs = [(d, " ".join(word() for _ in range(rng.randint(0, 9)))) for d in range(120)]
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(15)]
    assert rows(ranked_search(docs_frame(spark, docs), items_frame(spark, items), block_pairs=20)) == plain(docs, items)


def test_one_task_with_many_segments(spark, monkeypatch):
    """Strata visited, bounds and essential terms when the postings arrive in several segments of one task."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(strata_search, "SEGMENT", 200)
    rng = random.Random(9)
    vocabulary = 40
    docs = [(d, 25 + rng.randrange(30), Counter(min(int(rng.expovariate(0.1)), vocabulary - 1) for _ in range(rng.randint(1, 30)))) for d in range(600)]
    weights = [rng.randrange(0, 4000) for _ in range(vocabulary)]
    asked = [sorted({rng.randrange(vocabulary) for _ in range(rng.randint(1, 12))}) for _ in range(25)]
    bounds = np.cumsum([0, *map(len, asked)])
    term = np.array([t for a in asked for t in a])
    shared = type("Shared", (), {"value": (bounds, term, np.array(weights)[term], vocabulary, 10)})
    docs.sort(key=lambda r: r[1])
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    batches = []
    for at in range(0, len(docs), 7):
        part = [(d, m, list(c), list(c.values())) for d, m, c in docs[at:at + 7]]
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(kinds)], ["d", "m", "t", "f"]))
    (out,) = strata_search._searched(shared)(iter(batches))
    got = sorted(zip(*(c.to_pylist() for c in out.columns)))
    want = []
    for i, a in enumerate(asked):
        scores = [(-sum(weights[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in a if t in c), d) for d, m, c in docs]
        want += [(i, d, -s) for s, d in sorted(x for x in scores if x[0] < 0)[:10]]
    assert got == sorted(want)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " .,"), (None, "alpha beta"), (4, "alpha alpha"), (4, "alpha alpha"), (5, "beta " * 30_000), (6, "gamma")]
    items = [(1, "alpha beta"), (None, "Gamma"), (2, None), (3, "missing"), (1, "alpha beta")]
    assert rows(ranked_search(docs_frame(spark, docs), items_frame(spark, items))) == plain(docs, items)
    assert ranked_search(docs_frame(spark, []), items_frame(spark, items)).count() == 0
    assert ranked_search(docs_frame(spark, docs), items_frame(spark, [])).count() == 0
