import hashlib
import random

import numpy as np
import pytest

from stowline.llm import suffix_dedup
from stowline.llm.queries import QUERIES
from stowline.llm.suffix_dedup import remove_repeats, suffix_ranks
from tests.llm import brute
from tests.llm.data import docs_frame, table_rows

SF = "/root/testdata/sf0.01"


def digest(rows):
    return sorted(((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ranks_are_the_suffix_order():
    data = np.random.default_rng(1).integers(0, 2, 300, dtype=np.uint8)
    body = data.tobytes()
    for length in (1, 3, 8, 9, 40):
        parts = [body[i:i + length] for i in range(300)]
        rank = suffix_ranks(data, length)
        at = range(300 - length)
        assert all((parts[i] < parts[j]) == (rank[i] < rank[j]) for i in at for j in at)


def test_whole_table_against_all_strings(spark):
    want = brute.repeats(table_rows("documents", "doc_id, text", SF), 400)
    got = result(QUERIES["op8_suffix_dedup"](spark, SF))
    assert got == digest(want) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("limits", [(3 << 20, 4_000_000), (2000, 4_000_000), (2000, 50)])
def test_random_texts(spark, monkeypatch, keep_first, limits):
    monkeypatch.setattr(suffix_dedup, "SUFFIX_BYTES", limits[0])
    monkeypatch.setattr(suffix_dedup, "HASHED_STARTS", limits[1])
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rng = random.Random(2)
    parts = ["".join(rng.choice("abé \n") for _ in range(rng.randint(5, 70))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(20)) for _ in range(rng.randint(0, 30))))
            for i in range(40)]
    rows += [(90, rows[3][1]), (91, rows[3][1]), (92, None), (93, ""), (94, "ab" * 900), (95, "q" * 300)]
    got = result(remove_repeats(docs_frame(spark, rows), 30, keep_first=keep_first))
    assert got == digest(brute.repeats(rows, 30, keep_first))


def test_edges(spark):
    rows = [(1, "abc" * 30), (1, "abc" * 30), (None, "z" * 50), (2, "short"), (2, "short")]
    got = result(remove_repeats(docs_frame(spark, rows), 30))
    assert got == digest(brute.repeats(rows, 30))
    assert remove_repeats(docs_frame(spark, []), 30).count() == 0
    kept = remove_repeats(docs_frame(spark, [(7, "left " + "r" * 40), (8, "s" + "r" * 40)]), 40, with_text=True)
    assert {r.doc_id: bytes(r.kept) for r in kept.collect()} == {7: b"left ", 8: b"s"}
