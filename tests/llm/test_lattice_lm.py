import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest

from stowline.llm.lattice_lm import FLOOR, START, Lattice, Trie, fit_pieces, score_texts, vocabulary
from stowline.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.data import docs_frame, table_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def test_marginal_sums_all_segmentations():
    pieces = {START: 0.1, START + "a": 0.2, "a": 0.1, "ab": 0.25, "b": 0.05, "ba": 0.3}
    lattice = Lattice(pieces, 0.3)

    def total(text):
        if not text:
            return 0.3
        return sum(w * 0.7 * total(text[len(p):]) for p, w in pieces.items() if text.startswith(p))

    for word in ("a", "ab", "aab", "abababba", "b"):
        assert math.isclose(math.exp(lattice.marginal(word)), total(START + word), rel_tol=1e-12)
        found = {}
        lattice.expected(word, found)
        assert math.isclose(sum(n * len(p) for p, n in found.items()), len(word) + 1, rel_tol=1e-9)
    assert Lattice(pieces, 0.3).marginal("aé" * 3000) > -math.inf


def test_many_words_at_once_equal_one_by_one():
    rng = random.Random(3)
    lattice = Lattice(vocabulary(PATH), 0.25)
    trie = Trie(lattice)
    words = ["".join(rng.choice("abcdeéß日😀ngitr") for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["the", "z" * 47, "z" * 48, "ab" * 200, "x"]
    assert all(math.isclose(a, lattice.marginal(w), rel_tol=1e-12) for a, w in zip(trie.marginals(words), words))
    want = {}
    for w in words:
        lattice.expected(w, want)
    got = trie.expected(words)
    assert {p for p, n in want.items() if n > 1e-9 and p in lattice.logs} <= set(got)
    assert all(math.isclose(got.get(p, 0.0), n, rel_tol=1e-9, abs_tol=1e-9) for p, n in want.items() if p in lattice.logs)
    assert len(trie.marginals([])) == 0 and trie.expected([]) == {}


def plain_score(rows, lattice):
    """The score of each text by plain sums of products over segmentations."""
    train, docs = Counter(), 0
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            train.update(brute.words(t))
            docs += 1
    n = sum(train.values()) + docs
    seen = Counter(train.values())
    few = [seen[k] for k in range(1, 5)]
    cuts = [0.5] * 3
    if all(few):
        y = few[0] / (few[0] + 2 * few[1])
        cuts = [min(max(k - (k + 1) * y * few[k] / few[k - 1], 0.05), 0.95) for k in (1, 2, 3)]
    mass = (sum(cuts[min(c, 3) - 1] for c in train.values()) + 1) / (n + 1)
    pieces, go = {p: math.exp(w) for p, w in lattice.logs.items()}, math.exp(lattice.go)

    def spelled(word):
        text = START + word
        ways = [1.0] + [0.0] * len(text)
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - 16), end):
                part = text[begin:end]
                if part in pieces:
                    ways[end] += ways[begin] * pieces[part] * go
                elif len(part) == 1:
                    ways[end] += ways[begin] * (FLOOR * go) ** len(part.encode())
        return ways[-1] * math.exp(lattice.stop)

    out = []
    for d, t in rows:
        logs = [math.log10(max(train[w] - cuts[min(train[w], 3) - 1], 0) / (n + 1) + mass * spelled(w) if train[w] else mass * spelled(w)) for w in brute.words(t)]
        out.append((d, sum(logs) + math.log10(max(docs, 0.5) / (n + 1))))
    return out


def test_scores_equal_plain_sums(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "on", "mats", "élan", "x1", "new" + str(rng.randrange(30))]) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    counted = spark.createDataFrame([(w, c) for w, c in Counter(
        w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in brute.words(t)).items()], "w string, c long")
    want = dict(plain_score(rows, fit_pieces(counted, PATH)))
    for r in score_texts(docs_frame(spark, rows), PATH).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9), r


def base_of(rows):
    train = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            train.update([*brute.words(t), None])
    n, v = sum(train.values()), len(train)
    out = []
    for d, t in rows:
        tokens = [*brute.words(t), None]
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(tokens), sum(train[w] > 0 for w in tokens), n,
                    sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)))
    return out


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [tuple(g)[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g.base_score, w[5], rel_tol=1e-9) for g, w in zip(got, want))


def test_whole_table(spark):
    got = QUERIES["op7_lattice_lm"](spark, SF).collect()
    same(got, base_of(table_rows("documents", "doc_id, text", SF)))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("held_words", [2, 1000])
def test_edges(spark, held_words):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "A b c " * 3), (3, "A b c " * 3), (4, "é \t x"), (5, "zz" * 4000)]
    rows += [(i, f"word{i % 3} a") for i in range(10, 40)]
    same(score_texts(docs_frame(spark, rows), PATH, held_words=held_words).collect(), base_of(rows))
    assert score_texts(docs_frame(spark, []), PATH).count() == 0
    lone = [d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    assert score_texts(docs_frame(spark, [(d, "a b") for d in lone]), PATH).count() == 2
