"""Operator 7: likelihood of whole texts under a unigram lattice over an existing subword vocabulary.

A text is a sequence of words, each spelled by arcs of a lattice: the vocabulary's pieces, and for a word seen in the
training texts one arc that spans it. The vocabulary's scores give the first weights of the pieces (its ranks, by Zipf's
law); expected counts over all training words, from one forward-backward pass per round, refine them. Word arcs weigh
by discounted training counts, the discounted mass goes to the pieces. The forward recursion in log space sums over
all segmentations; as no piece spans a blank, the marginal of a text is the sum of those of its words in logarithms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import pick, pieces, remainder
from stowline.session import cut_lineage

START = "▁"
HELD_WORDS = 200_000
FLUSH = 300_000
FLOOR = 1e-7
WIDTHS = (6, 8, 10, 12, 16, 24, 48)
GROUP = 4000
HELD_BATCH = 40_000
ROUNDS = 2


class Lattice:
    """Log weights of pieces, of the end of a word, and the forward and backward recursions over one word."""

    def __init__(self, weights: dict[str, float], stop: float) -> None:
        self.logs = {p: math.log(w) for p, w in weights.items()}
        ends: dict[str, set[int]] = {}
        for p in weights:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        #: Lengths of the pieces that end with two given characters, in order.
        self.lengths = {two: tuple(sorted(n)) for two, n in ends.items()}
        self.stop, self.go = math.log(stop), math.log1p(-stop)
        self.byte = math.log(FLOOR)

    def arcs(self, text: str) -> list[list[tuple[int, float]]]:
        """For each end, the (begin, log weight) of the arcs there; a character outside the vocabulary goes by bytes."""
        logs, lengths, go = self.logs, self.lengths, self.go
        out: list[list[tuple[int, float]]] = [[]]
        for end in range(1, len(text) + 1):
            one = logs.get(text[end - 1])
            at = [(end - 1, (self.byte + go) * len(text[end - 1].encode("utf-8", "surrogatepass")) if one is None else one + go)]
            for n in lengths.get(text[max(end - 2, 0):end], ()):
                if n > end:
                    break
                w = logs.get(text[end - n:end])
                if w is not None:
                    at.append((end - n, w + go))
            out.append(at)
        return out

    def forward(self, arcs: list[list[tuple[int, float]]]) -> list[float]:
        alpha = [0.0]
        for at in arcs[1:]:
            if len(at) == 1:
                alpha.append(alpha[at[0][0]] + at[0][1])
                continue
            terms = [alpha[begin] + w for begin, w in at]
            top = max(terms)
            alpha.append(top + math.log(sum([math.exp(x - top) for x in terms])))
        return alpha

    def marginal(self, word: str) -> float:
        """Natural logarithm of the word's probability over all segmentations."""
        return self.forward(self.arcs(START + word))[-1] + self.stop

    def expected(self, word: str, into: dict[str, float], weight: float = 1.0) -> None:
        """Add the expected count of each piece in the word."""
        text = START + word
        arcs = self.arcs(text)
        alpha = self.forward(arcs)
        beta = [-math.inf] * len(text) + [0.0]
        for end in range(len(text), 0, -1):
            for begin, w in arcs[end]:
                x, y = beta[begin], beta[end] + w
                beta[begin] = max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -math.inf else y
                share = math.exp(min(alpha[begin] + w + beta[end] - alpha[-1], 0.0)) * weight
                piece = text[begin:end]
                into[piece] = into.get(piece, 0.0) + share


class Trie:
    """The pieces of a lattice as a tree in arrays, and both recursions over many short words at once.

    A node is a prefix of a piece; ``keys`` holds (parent << 21 | character) in order, so a step down for many places is one
    search in a sorted array. Nothing is hashed: the arcs are exactly those of :meth:`Lattice.arcs`.
    """

    def __init__(self, lattice: Lattice) -> None:
        self.lattice = lattice
        node: dict[str, int] = {"": 0}
        for p in lattice.logs:
            for n in range(1, len(p) + 1):
                node.setdefault(p[:n], len(node))
        names = [p for p in node if p]
        keys = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in names], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array([node[p] for p in names], np.int64)[order]
        self.weight = np.full(len(node), -np.inf)
        self.named: list[str] = [""] * len(node)
        for p, w in lattice.logs.items():
            self.weight[node[p]] = w + lattice.go
            self.named[node[p]] = p
        self.deepest = max(map(len, names), default=1)

    def _arcs(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log weights and nodes of the arcs, by (length - 1, word, begin), and the lengths of the words with their mark."""
        sizes = np.array([len(w) + 1 for w in words])
        codes = np.full((len(words), width), 0x1FFFFF, np.int64)
        flat = np.frombuffer("".join([START + w for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
        inside = np.arange(width) < sizes[:, None]
        codes[inside] = flat
        deep = min(self.deepest, width)
        weights = np.full((deep, len(words), width), -np.inf)
        nodes = np.zeros((deep, len(words), width), np.int32)
        at = np.flatnonzero(inside)
        now = np.zeros(len(at), np.int64)
        line = codes.ravel()
        room = width - at % width
        for n in range(deep):
            fits = room > n
            at, now, room = at[fits], now[fits], room[fits]
            want = now << 21 | line[at + n]
            place = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[place] == want
            at, now, room = at[hit], self.child[place[hit]], room[hit]
            weights[n].ravel()[at] = self.weight[now]
            nodes[n].ravel()[at] = now
        # A character that is no piece goes by its bytes.
        lost = inside & np.isneginf(weights[0])
        points = codes[lost]
        bytes_of = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        weights[0][lost] = (self.lattice.byte + self.lattice.go) * bytes_of
        nodes[0][lost] = 0
        return weights, nodes, sizes

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        both = np.stack(terms)
        top = both.max(axis=0)
        safe = np.where(np.isneginf(top), 0.0, top)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(both - safe).sum(axis=0))

    def _forward(self, weights: np.ndarray) -> np.ndarray:
        deep, n, width = weights.shape
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0.0
        for end in range(1, width + 1):
            alpha[end] = self._sum([alpha[end - k] + weights[k - 1, :, end - k] for k in range(1, min(deep, end) + 1)])
        return alpha

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[str], int]]:
        """Places and words of similar lengths, with the width that holds them; longer words than the last are left out."""
        sizes = np.array([len(w) + 1 for w in words])
        low = 0
        for width in WIDTHS:
            at = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for start in range(0, len(at), GROUP):
                some = at[start:start + GROUP]
                yield some, [words[i] for i in some], width

    def marginals(self, words: list[str]) -> np.ndarray:
        """:meth:`Lattice.marginal` of each word."""
        out = np.empty(len(words))
        for at, some, width in self._groups(words):
            weights, _, sizes = self._arcs(some, width)
            out[at] = self._forward(weights)[sizes, np.arange(len(some))] + self.lattice.stop
        for i, w in enumerate(words):
            if len(w) >= WIDTHS[-1]:
                out[i] = self.lattice.marginal(w)
        return out

    def expected(self, words: list[str]) -> dict[str, float]:
        """Expected counts of the pieces over all words, as :meth:`Lattice.expected` adds them up."""
        total = np.zeros(len(self.weight))
        for _, some, width in self._groups(words):
            weights, nodes, sizes = self._arcs(some, width)
            alpha = self._forward(weights)
            deep, n = len(weights), len(some)
            each = np.arange(n)
            whole = alpha[sizes, each]
            beta = np.full((width + 1, n), -np.inf)
            beta[sizes, each] = 0.0
            for begin in range(width - 1, -1, -1):
                open_here = sizes > begin
                found = self._sum([weights[k - 1, :, begin] + beta[begin + k] for k in range(1, min(deep, width - begin) + 1)])
                beta[begin] = np.where(open_here, found, beta[begin])
            for k in range(1, deep + 1):
                spans = width + 1 - k
                share = np.exp(np.minimum(alpha[:spans].T + weights[k - 1, :, :spans] + beta[k:].T - whole[:, None], 0.0))
                total += np.bincount(nodes[k - 1, :, :spans].ravel(), share.ravel(), len(total))
        out = {self.named[i]: total[i] for i in np.flatnonzero(total) if self.named[i]}
        for w in words:
            if len(w) >= WIDTHS[-1]:
                self.lattice.expected(w, out)
        return out


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a model file with weights from their scores: the file's scores are negative ranks, taken by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    order = sorted(ids, key=lambda i: (-model.get_score(i), i))
    raw = {model.id_to_piece(i): 1 / (rank + 3) for rank, i in enumerate(order)}
    total = sum(raw.values())
    return {p: w / total for p, w in raw.items()}


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c, a) of (d, x, train): counts of each word in training texts and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            words = [*counts[0], *counts[1]]
            seen = [*counts[0].values()], [*counts[1].values()]
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in words], pa.string()), pa.array([0] * len(seen[0]) + seen[1], pa.int64()),
                 pa.array(seen[0] + seen[1], pa.int64())], ["w", "c", "a"])
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for x, train in zip(batch.column("x").to_pylist(), batch.column("train").to_pylist()):
                if x:
                    counts[bool(train)].update(x.encode().lower().split())
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield rows()
        yield rows()

    return docs.select("x", "train").mapInArrow(run, "w string, c bigint, a bigint").groupBy("w").agg(
        F.sum("c").alias("c"), F.sum("a").alias("a"))


def gathered(batches: Iterator[pa.RecordBatch], most: int = HELD_BATCH) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``most`` rows, but for the last, so that words of one length come together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def fit_pieces(words: DataFrame, path: str, rounds: int = ROUNDS) -> Lattice:
    """Weights of the pieces after ``rounds`` of expectation over all distinct training words (w, c)."""
    weights, stop = vocabulary(path), 0.25
    first = dict(weights)
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((weights, stop))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = Trie(Lattice(*shared.value))
            found: Counter[str] = Counter()
            n = 0
            for some in gathered(batches):
                some = some.column("w").to_pylist()
                for p, x in trie.expected(some).items():
                    found[p] += x
                n += len(some)
            named = [p for p in found if p in trie.lattice.logs]
            yield pa.RecordBatch.from_arrays([pa.array(["", *named]), pa.array([float(n), *[found[p] for p in named]])], ["p", "n"])

        got = {r.p: r.n for r in words.where("c > 0").select("w").mapInArrow(run, "p string, n double").groupBy("p").agg(F.sum("n").alias("n")).collect()}
        types = got.pop("", 0.0)
        total = sum(got.values())
        if not total:
            break
        prior = 0.01 * total + 1
        weights = {p: (got.get(p, 0.0) + prior * first[p]) / (total + prior) for p in first}
        stop = types / (types + total)
    return Lattice(weights, stop)


def discounts(words: DataFrame) -> list[float]:
    """Discount of counts 1, 2 and 3 or more, from the counts of counts."""
    seen = {r.c: r.n for r in words.where("c BETWEEN 1 AND 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [seen.get(k, 0) for k in range(1, 5)]
    if not all(n):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), 0.95) for k in (1, 2, 3)]


def score_texts(docs: DataFrame, path: str, held_out: int = 2, folds: int = 7, doc_id: str = "doc_id", text: str = "text",
                held_words: int = HELD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text, one row per row.

    Texts whose crc32(id) mod ``folds`` is ``held_out`` are not learned from. Tokens are the words, A-Z lower-cased, and
    one end. base_score: add-one unigram in log10; score: log10 of the lattice's marginal. The ``held_words`` commonest
    words are broadcast, all others are joined. Null texts count as empty (an end alone); rows with a null id are
    learned from and not held out; repeated rows count as often as they occur; without training rows both scores rest
    on zero counts; an empty table gives an empty one; other columns are ignored.
    """
    own = pick(docs, d=doc_id, x=text).select(
        "d", F.coalesce("x", F.lit("")).alias("x"), F.coalesce(remainder("d", folds) == held_out, F.lit(False)).alias("out"))
    own = own.withColumn("train", ~F.col("out")).withColumn("t", F.xxhash64("x"))
    counted = cut_lineage(word_counts(own))
    train_docs = own.where("train").count()
    total, kinds = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = total + train_docs, kinds + (train_docs > 0)
    lattice = fit_pieces(counted, path)
    cuts = discounts(counted)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lattice)
    base = math.log10(n + v + 1)
    kept = counted.where("c > 0").agg(F.coalesce(F.sum(F.element_at(F.array(*[F.lit(x) for x in cuts]), F.least("c", F.lit(3)).cast("int"))), F.lit(0.0))).first()[0]
    mass = (kept + 1) / (n + 1)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in gathered(batches):
            counts = batch.column("c").to_numpy()
            lattice_logs = trie.marginals(batch.column("w").to_pylist())
            less = np.where(counts > 0, np.maximum(counts - np.array(cuts)[np.clip(counts, 1, 3) - 1], 0), 0) / (n + 1)
            with np.errstate(divide="ignore"):
                both = np.logaddexp(np.log(less), math.log(mass) + lattice_logs) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [batch.column("w"), pa.array((counts > 0).astype(np.int64)), batch.column("a"), pa.array(np.log10(counts + 1.0) - base), pa.array(both)],
                ["w", "known", "a", "base", "score"])

    words = cut_lineage(counted.mapInArrow(spelled, "w string, known bigint, a bigint, base double, score double"))
    common = words.orderBy(F.desc("a"), "w").limit(held_words).select("w", "known", "base", "score").toPandas()
    top = spark.sparkContext.broadcast((common["w"].tolist(), *[common[c].to_numpy(float) for c in ("known", "base", "score")]))
    end = (float(train_docs > 0), math.log10(train_docs + 1) - base, math.log10(max(train_docs, 0.5) / (n + 1)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, bases, scores = top.value
        place = {w.encode(): i for i, w in enumerate(names)}
        for batch in batches:
            for some in pieces(batch, "x"):
                mains: list[tuple] = []
                rest: list[tuple] = []
                for d, out, t, x in zip(*(some.column(c).to_pylist() for c in ("d", "out", "t", "x"))):
                    parts = x.encode().lower().split()
                    at = np.fromiter(map(place.get, parts, repeat(-1)), np.int64, len(parts))
                    hit = at[at >= 0]
                    mains.append((d, out, t, len(parts) + 1, known[hit].sum() + end[0], bases[hit].sum() + end[1], scores[hit].sum() + end[2]))
                    if len(hit) < len(parts):
                        rest += [(t, w.decode(), k) for w, k in Counter([parts[i] for i in np.flatnonzero(at < 0)]).items()]
                m, r = [*zip(*mains)], [*zip(*rest)] or [(), (), ()]
                pad, gap = [None] * len(rest), [None] * len(mains)
                columns = [pa.array([*m[0], *pad], pa.int64()), pa.array([*m[1], *pad], pa.bool_()), pa.array([*m[2], *r[0]], pa.int64()),
                           pa.array([*m[3], *pad], pa.int64()), *[pa.array([*map(float, m[i]), *pad], pa.float64()) for i in (4, 5, 6)],
                           pa.array([*gap, *r[1]], pa.string()), pa.array([*gap, *r[2]], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["d", "out", "t", "n_tokens", "known", "base", "score", "w", "k"])

    both = cut_lineage(own.select(F.col("d").cast("bigint").alias("d"), "out", "t", "x").mapInArrow(
        look, "d bigint, out boolean, t bigint, n_tokens bigint, known double, base double, score double, w string, k bigint"))
    rare = both.where("w IS NOT NULL").groupBy("t", "w").agg(F.max("k").alias("k")).join(words, "w").groupBy("t").agg(
        *[F.sum(F.col("k") * F.col(c)).alias(f"r_{c}") for c in ("known", "base", "score")])
    joined = both.where("w IS NULL").join(rare, "t", "left")
    full = {c: F.col(c) + F.coalesce(f"r_{c}", F.lit(0.0)) for c in ("known", "base", "score")}
    return joined.select(F.col("d").alias(doc_id), F.col("out").alias("held_out"), "n_tokens", full["known"].cast("bigint").alias("n_known"),
                         F.lit(n).cast("bigint").alias("train_tokens"), full["base"].alias("base_score"), full["score"].alias("score"))
