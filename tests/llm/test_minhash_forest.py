import random

from stowline.llm import minhash_forest
from stowline.llm.minhash_forest import near_duplicates
from stowline.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.data import docs_frame, table_rows

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_whole_table_against_all_pairs(spark):
    want = brute.near_duplicates(table_rows("documents", "doc_id, text", SF), 4)
    assert rows_of(QUERIES["op4_minhash_forest"](spark, SF)) == want


def test_large_group_of_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "DEEP_ROWS", 60)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((501 + i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(50))) for i in range(50)]
    assert rows_of(near_duplicates(docs_frame(spark, rows), size=4)) == brute.near_duplicates(rows, 4)


def test_edges(spark):
    long = " ".join(f"q{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "two one"), (7, long), (8, long + " end"),
            (9, "Ä b c d e f"), (10, "ä b c d e f"), (11, "same " * 30), (12, "same " * 500)]
    assert rows_of(near_duplicates(docs_frame(spark, rows), size=4)) == brute.near_duplicates(rows, 4)
    twice = rows_of(near_duplicates(docs_frame(spark, [(1, "a b c d"), (1, "e f g h"), (2, "E F G H"), (3, "a b c d"), (None, "a b c d")]), size=4))
    assert twice == {(1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 1, None, True)}
    assert near_duplicates(docs_frame(spark, []), size=4).count() == 0


def test_crowded_regions_lose_no_link(spark, monkeypatch):
    """Even where neighbours and hubs link nothing, the sets of a crowded region meet each other."""
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(minhash_forest, "candidates", lambda sets: (none, none))
    monkeypatch.setattr(minhash_forest, "TILE_LEFT", 16)
    monkeypatch.setattr(minhash_forest, "TILE_RIGHT", 32)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    assert rows_of(near_duplicates(docs_frame(spark, rows), size=4)) == brute.near_duplicates(rows, 4)


def test_crowded_sets_without_links_are_not_written_as_pairs(spark, monkeypatch):
    """Copies of one text edited so far that hardly any two are linked: their pairs meet in tiles and are never rows."""
    seen = []
    confirmed = minhash_forest.confirmed

    def counted(docs, pairs, size, percent):
        seen.append(pairs.count())
        return confirmed(docs, pairs, size, percent)

    monkeypatch.setattr(minhash_forest, "confirmed", counted)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(5):
            copy[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    assert rows_of(near_duplicates(docs_frame(spark, rows), size=4)) == brute.near_duplicates(rows, 4)
    assert sum(seen) < 60 * len(rows)
