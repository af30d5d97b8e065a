from collections import Counter

import pytest

from stowline.llm.decontaminate import decontaminate, leaks
from stowline.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.data import docs_frame, table_rows

SF = "/root/testdata/sf0.01"


def bag(words, size):
    width = min(size, len(words))
    return Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def plain(rows, items, size=5, percent=80):
    """Pairs of document and item for which any window of the item's size is similar enough."""
    found = set()
    for item, text in items:
        want = brute.words((text or "").lower())
        if not want:
            continue
        target = bag(want, size)
        for d, t in rows:
            have = brute.words((t or "").lower())
            if not bag(have, min(size, len(want))) & target:
                continue
            for s in range(max(1, len(have) - len(want) + 1)):
                got = bag(have[s:s + len(want)], min(size, len(want)))
                both = sum((got & target).values())
                if both and 100 * both >= percent * (sum(got.values()) + sum(target.values()) - both):
                    found.add((d, item))
                    break
    return found


def test_whole_table(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontaminate"](spark, SF).collect()}
    rows, items = table_rows("documents", "doc_id, text", SF), table_rows("benchmark", "item_id, text", SF)
    near = [(d, t) for d, t in rows]
    assert got == plain(near, items)


@pytest.fixture
def items(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(40)), 1), (2, "short one", 1), (3, None, 1), (4, "", 1), (5, "same " * 12, 1), (None, "no id for this item here", 1)]
    return rows, spark.createDataFrame(rows, "item_id long, text string, t int")


def test_edits_and_edges(spark, items):
    words = [f"w{i}" for i in range(40)]
    rows = [
        (1, "x " * 30 + " ".join(words) + " y" * 50), (2, " ".join(words[:20]) + " odd " + " ".join(words[20:])),
        (3, " ".join(words[:38])), (4, " ".join(words[:25])), (5, "A SHORT One b"), (6, None), (7, ""), (8, "same " * 300),
        (9, "no ID for this item here"), (None, " ".join(words)), (1, "clean text"), (10, " ".join(["z"] + words[2:] + ["q"])), (11, "long " * 30_000),
    ]
    frame = docs_frame(spark, rows)
    found = leaks(frame, items[1])
    import pyspark.sql.functions as F

    got = {(r.doc_id, r.item_id) for r in frame.select("doc_id", F.xxhash64("text").alias("t")).join(found, "t").collect()}
    assert got == plain(rows, [(i, t) for i, t, _ in items[0] if i is not None])
    kept = decontaminate(frame, found)
    assert kept.columns == frame.columns
    bad = {d for d, _ in got}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([d for d, t in rows if d not in bad or t == "clean text"], key=str)
    assert leaks(frame, items[1].limit(0)).count() == 0 and leaks(frame.limit(0), items[1]).count() == 0
