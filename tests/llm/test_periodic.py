import hashlib
import random
import zlib

import numpy as np
import pytest

from stowline.llm.periodic import WaveletTree, periodic_runs, strongest, text_runs
from tests.llm.data import SF_DIR, docs_frame, table_rows


def plain_runs(w, times=4, least=6):
    """Every period in turn, extended word by word; the smallest period of a stretch stays."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, w):
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def repetitive(rng):
    out, letters = [], [b"a", b"b", b"c", b"d"][: rng.choice([1, 2, 2, 3, 4])]
    while len(out) < rng.randint(0, 90):
        part = [rng.choice(letters) for _ in range(rng.randint(1, 23))]
        out += part * rng.randint(1, 7)
        out = out[: len(out) - rng.randint(0, 3)]
    return out


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    values = rng.permutation(500)
    tree = WaveletTree(values, 9)
    low, high, after = rng.integers(0, 250, 300), rng.integers(250, 501, 300), rng.integers(-1, 500, 300)
    want = [min((v for v in values[a:b] if v > x), default=-1) for a, b, x in zip(low, high, after)]
    assert tree.successor(low, high, after).tolist() == want


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_repetitive_words(seed):
    rng = random.Random(seed)
    for _ in range(150):
        bodies = [repetitive(rng) for _ in range(rng.randint(1, 10))]
        assert text_runs(bodies) == [plain_runs(b) for b in bodies]


def test_hard_words():
    a, b = b"a", b"ab"
    while len(b) < 1500:
        a, b = b, b + a
    fibonacci = [b[i:i + 1] for i in range(len(b))]
    nested = [x.encode() for x in "x y x y x y x y z ".split() * 9 + ["x"] * 40 + "p q r ".split() * 11]
    assert text_runs([fibonacci, nested, [b"w"] * 700]) == [plain_runs(fibonacci), plain_runs(nested), [(0, 700, 1)]]


def test_whole_table(spark):
    from stowline.llm.queries import QUERIES

    got = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()))
    want = sorted(plain_row(d, planted(d, t)) for d, t in table_rows("documents", "doc_id, text"))
    assert [r[:1] + r[1:] for r in got] == want and sum(r[1] > 0 for r in want) > 5


def test_edges(spark):
    long = "one two three " * 40_000
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a a a a a a a"), (4, "b c " * 4), (4, "b c " * 4), (5, long), (6, "x x x x x")]
    out = periodic_runs(docs_frame(spark, rows))
    assert out.columns == ["doc_id", "n_runs", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_runs, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    want = [(d, len(f), f, c) for d, f, c in [
        (1, [], ""), (2, [], ""), (3, [], ""), (None, [(0, 7, 1)], "a"), (4, [(0, 8, 2)], "b c"), (4, [(0, 8, 2)], "b c"),
        (5, [(0, 120_000, 3)], "one two three"), (6, [], "x x x x x")]]
    assert got == sorted(want, key=str)
    assert periodic_runs(docs_frame(spark, [])).count() == 0
    assert strongest([(0, 12, 3), (4, 8, 2), (20, 16, 4)]) == (0, 12, 3)
    with pytest.raises(ValueError):
        periodic_runs(out, times=2)
