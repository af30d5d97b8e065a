"""Operator 10: toxicity by a gapped-subsequence string kernel, a Nyström map over landmark words and a linear SVM.

The kernel of two words counts the triples of characters that both contain in order, each weighted by ``DECAY`` to the
power of its span, so inserted characters and gaps lower a match but don't break it. The SVM is trained on the Nyström
features of words; as it is linear in them, and they are linear in the weights of the triples, its decision function
folds into one weight a triple, and scoring a word needs no loop over landmarks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import pick, pieces, remainder

SYMBOLS = 64
SPAN = 7
DECAY = 0.7
WINDOW, STRIDE = 24, 12
SAMPLE_ROWS = 4000
LANDMARKS = 256
NEGATIVES = 3000
CLEAN_RATE = 0.02
CACHED_WORDS = 100_000
#: Texts whose words wait for their values at once: their sets take some fifteen times the texts' own bytes.
SCORE_BYTES = 1 << 20
THRESHOLD = 0.3
SECOND = 0.1
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){3,}\S(?!\S)")
_codes = np.array([ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 36 for c in map(chr, range(128))], dtype=np.int64)


def coded(words: list[str]) -> np.ndarray:
    """Symbols of words of one length, with a begin and an end mark."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1)
    body = np.where(points < 128, _codes[np.minimum(points, 127)], 26 + points % 36)
    mark = np.full((len(words), 1), SYMBOLS - 2)
    return np.concatenate([mark, body, mark + 1], axis=1)


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = [(i, j, k) for i in range(n) for j in range(i + 1, min(i + SPAN, n)) for k in range(j + 1, min(i + SPAN, n))]
    i, j, k = np.array(found).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, triple, value) of the normalised kernel features of words of one length."""
    symbols = coded(words)
    i, j, k, decay = triples(symbols.shape[1])
    keys = (symbols[:, i] * SYMBOLS + symbols[:, j]) * SYMBOLS + symbols[:, k]
    keys += np.arange(len(words))[:, None] * SYMBOLS**3
    flat = keys.ravel()
    order = np.argsort(flat)
    flat = flat[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    value = np.add.reduceat(np.tile(decay, len(words))[order], starts)
    row, triple = np.divmod(flat[starts], SYMBOLS**3)
    norm = np.sqrt(np.bincount(row, value * value, len(words)))
    return row, triple, value / norm[row]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positions and words of each length, at most 1,000 at once."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for start in range(0, len(at), 1000):
            some = at[start:start + 1000]
            yield some, [words[x] for x in some]


def normal(token: str) -> str:
    """The token without signs, also those set between its letters; a token of signs alone stays."""
    if token.isalnum():
        return token
    return "".join(filter(str.isalnum, token)) or token


def windows(word: str) -> list[str]:
    """A long token as overlapping windows, all of it."""
    if len(word) <= WINDOW:
        return [word]
    last = len(word) - WINDOW
    return [word[s:s + WINDOW] for s in [*range(0, last, STRIDE), last]]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        """Decision value of each token, the greatest over the windows of a long one."""
        spans, owner = [], []
        for n, word in enumerate(words):
            for part in windows(normal(word)):
                spans.append(part)
                owner.append(n)
        found = np.zeros(len(spans))
        for at, some in by_length(spans):
            row, triple, value = features(some)
            found[at] = np.bincount(row, value * self.weights[triple], len(some))
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.array(owner, dtype=int), found)
        return out + self.bias

    def top(self, margins: list[float]) -> float:
        """Evidence of a text: its best word, and by a share its second; one that no word reaches counts as clean."""
        if not margins:
            return self.bias
        first = max(margins)
        if len(margins) == 1:
            return first + SECOND * min(self.bias, 0.0)
        margins.remove(first)
        return first + SECOND * min(max(margins), first)

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def tokens(text: str) -> set[str]:
    """Distinct lower-cased tokens; runs of four or more single characters count as one word too."""
    lower = text.lower()
    found = set(lower.split())
    for run in _SPACED.findall(lower):
        found.add("".join(run.split()))
    return found


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3e-4, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps in the primal."""
    ones = np.c_[x, np.ones(len(x))]
    w = np.zeros(ones.shape[1])
    damp = np.full(len(w), ridge * weight.sum())
    damp[-1] = 1e-6
    for _ in range(rounds):
        active = y * (ones @ w) < 1
        part, by = ones[active], weight[active]
        new = np.linalg.solve((part * by[:, None]).T @ part + np.diag(damp), (part * by[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _nystroem(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks' features over the triples that they use, and the map from kernel values to Nyström features."""
    rows = []
    for at, some in by_length(landmarks):
        row, triple, value = features(some)
        rows.append((at[row], triple, value))
    row, triple, value = (np.concatenate(x) for x in zip(*rows))
    used, column = np.unique(triple, return_inverse=True)
    dense = np.zeros((len(landmarks), len(used)))
    dense[row, column] = value
    values, vectors = np.linalg.eigh(dense @ dense.T)
    keep = values > 1e-6
    return used, dense.T @ (vectors[:, keep] / np.sqrt(values[keep]))


def fit_words(bags: list[tuple[int, list[str]]], rows: tuple[int, int], landmarks: int = LANDMARKS, rounds: int = 3) -> Model:
    """Train on bags (toxic, tokens): a toxic bag holds at least one toxic word, a clean one none.

    The witness of each toxic bag is its word of greatest decision value; it starts as the word whose presence tells
    the classes apart best. Bags without a witness that others bear out don't train, as their labels may be wrong. ``rows``: clean and toxic rows that the sample stands for, which weight the calibration.
    """
    flat = Model(np.zeros(SYMBOLS**3), 0.0, 0.0, -40.0)
    # Texts share most of their words, so each word's windows are made once and the bags hold references.
    parts: dict[str, list[str]] = {}
    for _, words in bags:
        for w in words:
            if w not in parts:
                parts[w] = windows(normal(w))
    shared: dict[str, str] = {}
    bags = [(y, sorted({shared.setdefault(part, part) for w in words for part in parts[w]})) for y, words in bags]
    parts.clear()
    toxic = [words for y, words in bags if y and words]
    clean = [words for y, words in bags if not y]
    if not toxic:
        return flat
    unseen = clean[1::2] if len(clean) >= 400 else clean
    learned = clean[::2] if len(clean) >= 400 else clean
    in_toxic, in_clean = Counter(w for ws in toxic for w in ws), Counter(w for ws in learned for w in ws)

    def common(w: str) -> bool:
        return in_clean[w] > CLEAN_RATE * len(learned)

    def telling(w: str) -> float:
        a, b = (in_toxic[w] + 0.1) / (len(toxic) + 1), (in_clean[w] + 0.1) / (len(learned) + 1)
        return a * np.log(a / b) - 10 * common(w)

    witnesses = [max(words, key=lambda w: (telling(w), w)) for words in toxic]
    order = sorted(in_clean, key=lambda w: (hash_of(w), w))
    hard: list[str] = []
    model = flat
    every = sorted({*in_toxic, *in_clean})
    # Labels err, and a word of few toxic texts alone may be any of their words. A witness has to stand in so many toxic texts,
    # copies counted once, that not one word of all would by chance stand in these only; or in the square root of them.
    told = Counter(w for ws in {tuple(ws) for ws in toxic} for w in ws)
    chance = np.log(len(toxic) / (len(toxic) + len(learned))) if learned else -1.0
    least = max(2, int(min(len(toxic) ** 0.5, np.log(len(told) + 1) / -chance)))
    # Words that many toxic texts and hardly a clean one hold are toxic even where a text has a better witness.
    plain = {w: n for w, n in told.items() if n >= least and not in_clean[w]}
    for _ in range(rounds):
        positive = Counter([w for w in witnesses if told[w] >= least] or witnesses)
        for w, n in plain.items():
            positive[w] = max(positive[w], n)
        negative = list(dict.fromkeys(w for w in [*hard, *order[:NEGATIVES]] if w not in positive or in_clean[w] > in_toxic[w]))
        chosen = [w for w, _ in positive.most_common(landmarks // 2)]
        used, basis = _nystroem(list(dict.fromkeys([*chosen, *negative[: landmarks - len(chosen)]])))
        changed = {v: n**0.5 / 3 for w, n in positive.items() for v in spellings(w) if not in_clean[v] and v not in positive}
        words = [*positive, *changed, *negative]
        ups = len(positive) + len(changed)
        y = np.array([1.0] * ups + [-1.0] * len(negative))
        weight = np.array([n**0.5 for n in positive.values()] + [*changed.values()] + [max(in_clean[w], 1) ** 0.5 for w in negative])
        weight[:ups] *= 0.5 * weight[ups:].sum() / weight[:ups].sum() if negative else 1.0
        x = np.zeros((len(words), basis.shape[1]))
        for at, some in by_length(words):
            row, triple, value = features(some)
            place = np.minimum(np.searchsorted(used, triple), len(used) - 1)
            own = used[place] == triple
            for start in range(0, len(some), 500):
                dense = np.zeros((min(500, len(some) - start), len(used)))
                now = own & (row >= start) & (row < start + 500)
                dense[row[now] - start, place[now]] = value[now]
                x[at[start:start + 500]] = dense @ basis
        w, bias = _svm(x, y, weight)
        folded = np.zeros(SYMBOLS**3)
        folded[used] = basis @ w
        model = Model(folded, bias, 1.0, 0.0)
        margin = dict(zip(every, model.margins(every)))
        witnesses = [max(words, key=lambda w: (margin[w] + 0.2 * (in_clean[w] == 0) - 10 * common(w), w)) for words in toxic]
        hard = sorted(in_clean, key=lambda w: (-margin[w], w))[: NEGATIVES // 4]
    def best(some: list[list[str]]) -> np.ndarray:
        every = sorted({w for ws in some for w in ws})
        margin = dict(zip(every, model.margins(every)))
        return np.array([model.top([margin[w] for w in ws]) for ws in some])

    backed = [words for words, w in zip(toxic, witnesses) if told[w] >= least] or toxic
    high, low = best(backed), best(unseen)
    weight = np.r_[np.full(len(high), rows[1] / len(backed)), np.full(len(low), rows[0] / max(len(unseen), 1))]
    model.slope, model.offset = _logistic(np.r_[high, low], np.r_[np.ones(len(high)), np.zeros(len(low))], weight)
    if len(low) and (gap := np.quantile(high, 0.02) - (top := np.quantile(low, 0.998))) > 0:
        # The classes part: the threshold goes nearer to the clean side, as disguised words score below plain ones.
        model.offset = float(np.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * (top + gap / 4))
    return model


def spellings(word: str) -> list[str]:
    """Three disguised spellings of a word of four letters or more, the places drawn from its hash."""
    if len(word) < 4:
        return []
    at = 1 + hash_of(word) % (len(word) - 2)
    return [word[:at] + "x" + word[at:], word[:at] + "0" + word[at + 1:], word[:at] + word[at] + word[at:]]


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a penalised logistic fit."""
    ones = np.c_[x, np.ones(len(x))]
    w = np.zeros(2)
    weight = weight / weight.sum() * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ones @ w, -40, 40)))
        slope = (ones * (weight * (y - p))[:, None]).sum(0) - 0.05 * w
        curve = (ones * (weight * p * (1 - p))[:, None]).T @ ones + 0.05 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text",
        target: str = "toxic") -> Model:
    """Train on at most ``sample_rows`` labelled documents, half of each class, taken by the hash of their id.

    Rows whose crc32(id) mod 4 is 2 are held out. Null labels, ids and texts take no part; of contradicting labels the
    greater counts. Without a toxic row the model gives 0 to every text.
    """
    marked = (
        pick(labels, d=doc_id, y=target).where("d IS NOT NULL AND y IS NOT NULL").where(remainder("d", 4) != 2)
        .groupBy("d").agg(F.max("y").alias("y"))
    )
    counts = {int(r.y): r["count"] for r in marked.groupBy("y").count().collect()}
    half = sample_rows // 2
    chosen = None
    for y in (0, 1):
        one = marked.where(F.col("y") == y).orderBy(F.xxhash64("d"), "d").limit(half)
        chosen = one if chosen is None else chosen.unionByName(one)
    found = (
        pick(docs, d=doc_id, t=text).where("t IS NOT NULL").join(F.broadcast(chosen), "d")
        .select("d", "y", F.array_distinct(F.split(F.lower("t"), r"\s+")).alias("w"))
        .toArrow().sort_by("d")
    )
    known: dict[str, str] = {}
    rows = []
    for y, words in zip(found.column("y").to_pylist(), found.column("w")):
        rows.append((int(y), [known.setdefault(w, w) for w in words.as_py() if w]))
    del found, known
    return fit_words(rows, (counts.get(0, 0), counts.get(1, 0)))


def _scorer(model: Model):
    """A function from arrays of texts to arrays of scores, with the words' values remembered up to a bound.

    However many texts come at once, only the words of about ``SCORE_BYTES`` of them are held.
    """
    known: dict[str, float] = {}
    empty = model.score(model.bias)

    def some_scores(texts: list[str | None]) -> pa.Array:
        found = [tokens(t) if t else set() for t in texts]
        new = list({w for ws in found for w in ws if w not in known})
        for start in range(0, len(new), 20_000):
            part = new[start:start + 20_000]
            known.update(zip(part, model.margins(part).tolist()))
        out = [model.score(model.top([known[w] for w in ws])) if ws else empty for ws in found]
        if len(known) > CACHED_WORDS:
            known.clear()
        return pa.array(out, pa.float64())

    def scores(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["t"])
        return pa.chunked_array([some_scores(some.column("t").to_pylist()) for some in pieces(batch, "t", SCORE_BYTES)], pa.float64()).combine_chunks()

    return scores


def toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted) of every whole text, one row per row; ``keep`` names further columns to carry, of other names.

    A text scores by its word of greatest decision value, so each word counts however long the text is. Null, empty
    and blank texts score as a word without any known triple does; null ids are kept; repeated rows score alike; an
    empty table gives an empty one; other columns are ignored. One map without a shuffle; the model is one table of
    64**3 weights (2 MB).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    carried = {f"c{i}": name for i, name in enumerate(keep)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for batch in batches:
            for some in pieces(batch, "t"):
                found = scores(some.column("t"))
                high = [int(s >= threshold) for s in found.to_pylist()]
                columns = [some.column("d"), *[some.column(c) for c in carried], found, pa.array(high, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [doc_id, *keep, "score", "predicted"])

    schema = ", ".join([f"`{doc_id}` {kinds[doc_id]}", *[f"`{n}` {kinds[n]}" for n in keep], "score double", "predicted int"])
    return pick(docs, d=doc_id, t=text, **carried).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose text scores below ``threshold``; see :func:`toxicity`.

    Only the texts go to Python and only scores come back; the rows wait in the JVM, which may spill them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = _scorer(shared.value)
        for part in parts:
            yield scores(part)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.where(score(F.col("row").getField(text)) < threshold).select("row.*")
