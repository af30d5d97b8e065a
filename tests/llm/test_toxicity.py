import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stowline.llm.queries import QUERIES
from stowline.llm.toxicity import DECAY, SPAN, Model, _scorer, fit, fit_words, features, tokens, toxicity
from tests.llm.data import docs_frame, table_rows

SF = "/root/testdata/sf0.1"


def plain_kernel(a, b):
    def weights(word):
        word, found = f"\x01{word}\x02", {}
        for i in range(len(word)):
            for j in range(i + 1, min(i + SPAN, len(word))):
                for k in range(j + 1, min(i + SPAN, len(word))):
                    key = word[i] + word[j] + word[k]
                    found[key] = found.get(key, 0) + DECAY ** (k - i + 1)
        return found

    x, y = weights(a), weights(b)
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    return dot / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_features_are_the_subsequence_kernel():
    words = ["banana", "bandan", "cabana", "xyzuvw"]
    dense = np.zeros((4, 64**3))
    row, triple, value = features(words)
    dense[row, triple] = value
    for a in range(4):
        for b in range(4):
            assert abs(dense[a] @ dense[b] - plain_kernel(words[a], words[b])) < 1e-12


def test_disguised_words():
    clean = [(0, f"the plain text number{i} goes on with nothing odd {'abcdefgh'[i % 8]}ther".split()) for i in range(300)]
    bad = [(1, f"the plain text number{i} goes {w} on".split()) for i in range(60) for w in ("idiot", "worthless")]
    model = fit_words(clean + bad, (300, 120))
    assert min(model.margins(["idiot", "i.d.i.o.t", "worthxless", "idiiot"])) > max(model.margins(["plain", "number7", "goes", "odd"]))
    assert "stupid" in tokens("so s t u p i d") and "a" in tokens("a b")


def test_memory_of_scoring_follows_a_slice():
    texts = pa.array([" ".join(f"w{(i * 7 + j * j) % 3001}" for j in range(200)) for i in range(6000)] + [None, ""])
    scores = _scorer(Model(np.linspace(-1, 1, 64**3), 0.0, 1.0, 0.0))
    tracemalloc.start()
    got = scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    assert got.to_pylist() == [s for i in range(0, len(texts), 2000) for s in scores(texts[i:i + 2000]).to_pylist()]


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    assert len(got) == 10_000
    marks = [(bool(y), got[d].predicted) for d, y in table_rows("labels", "doc_id, toxic", SF) if got[d].held_out]
    right = sum(y == p for y, p in marks)
    assert len(marks) > 500 and right / len(marks) > 0.96
    found = sum(p for y, p in marks if y)
    assert found / sum(y for y, _ in marks) > 0.8


def test_edges(spark):
    rows = [(i, f"all fine here {i}") for i in range(40)] + [(100 + i, f"all moron here {i}") for i in range(40)]
    rows += [(900, None), (901, ""), (902, " \n"), (None, "x"), (903, "fine " * 30_000 + "moron"), (903, "fine"), (904, "z" * 9000)]
    docs = docs_frame(spark, rows)
    labels = spark.createDataFrame([(d, 1, int(d >= 100)) for d, _ in rows if d is not None and d < 900] + [(None, 1, 1), (5, 1, None)],
                                   "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    out = toxicity(docs, model, keep=("lang",))
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id == 903] == [1, 0]
    assert all(r.predicted == 1 for r in got if r.doc_id in range(100, 140))
    empty = toxicity(docs, fit(docs, labels.limit(0)))
    assert {r.predicted for r in empty.collect()} == {0}
    assert toxicity(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_samples(n):
    assert np.isfinite(fit_words([(1, ["bad"])] * n + [(0, ["good"])] * n, (n, n)).slope)
