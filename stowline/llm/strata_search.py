"""Operator 11: ranked lexical search over a length-stratified index.

Documents of equal normaliser m form a stratum, and within a stratum a term's postings lie by term frequency, so an
impact is computed once for each frequency. The impacts of a term's greatest frequencies bound what a stratum can give an
item; strata are visited in the order of their bounds until a bound falls below the item's last rank. Inside a stratum
terms whose bounds together stay below that rank bring up no document; what the others bring up is scored in full.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowline.llm.common import pick, pieces
from stowline.session import cut_lineage

BLOCK_PAIRS = 300_000
SEGMENT = 1_000_000
STRATUM_ROWS = 1 << 16
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """ASCII letters (A-Z lower-cased) and digits and all other characters beyond ASCII, in maximal runs."""
    return text.encode().translate(_KEPT).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(i, w, c): how often each term stands in item i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "x"):
                rows = [(i, w.decode(), c) for i, x in zip(some.column("i").to_pylist(), some.column("x").to_pylist())
                        for w, c in Counter(terms(x)).items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["i", "w", "c"])

    return items.mapInArrow(run, "i bigint, w string, c bigint")


def forward_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(d, n, t, f) of each text with a term: its length in terms, and the numbers and frequencies of those listed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w.encode(): k for k, w in enumerate(shared.value)}
        for batch in batches:
            for some in pieces(batch, "x"):
                out: list[tuple] = []
                for d, x in zip(some.column("d").to_pylist(), some.column("x").to_pylist()):
                    words = terms(x)
                    if words:
                        found = Counter(words)
                        own = [w for w in found if w in number]
                        out.append((d, len(words), [number[w] for w in own], [found[w] for w in own]))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["d", "n", "t", "f"])

    return docs.mapInArrow(run, "d bigint, n bigint, t array<int>, f array<int>")


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    sizes = ends - begins
    shift = np.repeat(begins - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(sizes) else np.empty(0, np.int64)
    return np.arange(int(sizes.sum())) + shift


class Items:
    """The items of a block as one weight a term, and their best documents so far."""

    def __init__(self, bounds: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, top: int) -> None:
        self.bounds, self.term, self.weight, self.top = bounds, term, weight, top
        self.scratch = np.zeros(size, np.int64)
        n = len(bounds) - 1
        self.least = np.ones(n, np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * n

    def offer(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.least[i]
        score, d = np.r_[self.best[i][0], scores[some]], np.r_[self.best[i][1], ids[some]]
        order = np.lexsort((d, -score))[: self.top]
        self.best[i] = score[order], d[order]
        if len(order) == self.top:
            self.least[i] = score[order[-1]]

    def search(self, index: Segment) -> None:
        """Visit the strata of a segment for each item, those of greatest bound first."""
        most = np.zeros(len(self.scratch), np.int64)
        table = np.zeros((len(index.strata), len(self.best)), np.int64)
        filled = np.flatnonzero(self.bounds[1:] > self.bounds[:-1])
        for s, (term, impact) in enumerate(index.greatest):
            most[term] = impact
            table[s, filled] = np.add.reduceat(self.weight * most[self.term], self.bounds[filled])
            most[term] = 0
        order = np.argsort(-table, axis=0, kind="stable")
        for i in filled.tolist():
            for s in order[:, i].tolist():
                if table[s, i] < self.least[i]:
                    break
                self.visit(i, s, index)

    def visit(self, i: int, s: int, index: Segment) -> None:
        term, weight = (x[self.bounds[i]:self.bounds[i + 1]] for x in (self.term, self.weight))
        have, impact = index.greatest[s]
        place = np.minimum(np.searchsorted(have, term), len(have) - 1)
        here = have[place] == term
        place, weight_here = place[here], weight[here]
        bound = weight_here * impact[place]
        rising = np.argsort(bound, kind="stable")
        reached = np.cumsum(bound[rising])
        first = int(np.searchsorted(reached, self.least[i]))
        chosen, rest = rising[first:], int(reached[first - 1]) if first else 0
        begins, ends = index.places[s]
        spans = begins[place[chosen]], ends[place[chosen]]
        at = _ranges(*spans)
        low, high = index.strata[s]
        part = np.bincount(index.owner[at] - low, np.repeat(weight_here[chosen], spans[1] - spans[0]) * index.impact[at], high - low)
        alive = low + np.flatnonzero((part > 0) & (part + rest >= self.least[i]))
        if first and len(alive):
            self.scratch[term] = weight
            sizes = index.stop[alive] - index.start[alive]
            own = _ranges(index.start[alive], index.stop[alive])
            part = np.bincount(np.repeat(np.arange(len(alive)), sizes), self.scratch[index.all_terms[own]] * index.all_impacts[own], len(alive))
            self.scratch[term] = 0
        else:
            part = part[alive - low]
        self.offer(i, part.astype(np.int64), index.ids[alive])


class Segment:
    """Documents (sorted by m) with their terms: strata, postings by stratum, term and frequency, and impacts."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        order = np.argsort(m, kind="stable")
        if (order[1:] < order[:-1]).any():
            at = _ranges((np.cumsum(sizes) - sizes)[order], np.cumsum(sizes)[order])
            ids, m, sizes, term, tf = ids[order], m[order], sizes[order], term[at], tf[at]
        self.ids = ids
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        owner = np.repeat(np.arange(len(ids)), sizes)
        new = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        self.strata = [(a, b) for x, y in zip(new.tolist(), [*new[1:].tolist(), len(m)])
                       for a, b in zip(range(x, y, STRATUM_ROWS), [*range(x + STRATUM_ROWS, y, STRATUM_ROWS), y])]
        edges = np.array([a for a, _ in self.strata])
        stratum = (np.searchsorted(edges, np.arange(len(ids)), side="right") - 1)[owner]
        # One impact for each frequency of a normaliser.
        kinds, which = np.unique(m[owner] * (1 << 32) + tf, return_inverse=True)
        of_m, of_tf = kinds >> 32, kinds & ((1 << 32) - 1)
        self.all_terms, self.all_impacts = term, ((1_000_000_000 * of_tf) // (1000 * of_tf + 8 * of_m))[which]
        by = np.lexsort((tf, term, stratum))
        self.owner, self.impact = owner[by], self.all_impacts[by]
        term, stratum = term[by], stratum[by]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])]) if len(term) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(term)] if len(term) else first
        cut = np.searchsorted(stratum[first], np.arange(len(self.strata) + 1))
        spans = [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        # Impacts rise with the frequency, so a term's greatest is that of its last posting.
        self.greatest = [(term[first[x]], self.impact[last[x] - 1]) for x in spans]
        self.places = [(first[x], last[x]) for x in spans]


def _searched(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def close() -> None:
            if held:
                items.search(Segment(*(np.concatenate(x) for x in zip(*held))))
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            t, f = batch.column("t"), batch.column("f")
            held.append((batch.column("d").to_numpy(), batch.column("m").to_numpy(), t.value_lengths().to_numpy().astype(np.int64),
                         t.flatten().to_numpy().astype(np.int64), f.flatten().to_numpy().astype(np.int64)))
            size += len(held[-1][3]) + batch.num_rows
            if size >= SEGMENT:
                close()
                size = 0
        close()
        found = [(i, d, s) for i, (score, ids) in enumerate(items.best) for s, d in zip(score.tolist(), ids.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], ["i", "d", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of greatest score above 0 for each item, ranks from 1.

    Terms: see :func:`terms`. A term weighs floor(1000 ln((2N + 2) / (2 df + 1))), N documents with a term, df of them with
    this one; m = 25 + 75 n N div L, n terms in the document, L in all; the score sums weight * (10**9 tf div
    (1000 tf + 8 m)) over the item's terms, repeats included. Equal scores go by ascending id. Null, empty and blank texts
    have no terms, give an item no rows and count nowhere; documents with a null id count in the statistics and are
    not ranked; repeated rows of either table are rows of their own (repeated documents are ranked each, a repeated item's
    rows come twice); empty tables give an empty result; other columns are ignored.

    Items are dealt into blocks of about ``block_pairs`` different terms, which bounds what is broadcast; each block reads
    the texts once, keeps the postings of its terms, and shuffles them by stratum, a large stratum in pieces by row. A
    task holds about a million postings at once and gives at most ``top`` rows an item.
    """
    asked = cut_lineage(pick(items, q=item_id, x=item_text).withColumn("i", F.monotonically_increasing_id()))
    pairs = cut_lineage(item_terms(asked.select("i", "x")))
    blocks = max(1, math.ceil(pairs.count() / block_pairs))
    out = None
    for b in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toPandas()
        found = _ranked_block(pick(docs, d=doc_id, x=text), block, top)
        out = found if out is None else out.unionByName(found)
    names = asked.select("i", F.col("q").alias(item_id))
    return out.join(names, "i").select(item_id, "rank", F.col("d").alias(doc_id), "score")


def _ranked_block(docs: DataFrame, block, top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(set(block["w"]))
    number = {w: k for k, w in enumerate(vocabulary)}
    forward = cut_lineage(forward_index(docs.select(F.col("d").cast("bigint").alias("d"), "x"), vocabulary))
    n, total = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = {r.t: r.df for r in forward.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * holding.get(k, 0) + 1))) for k in range(len(vocabulary))], np.int64)
    names = sorted(set(block["i"]))
    row = {i: k for k, i in enumerate(names)}
    order = sorted((row[i], number[w], c) for i, w, c in zip(block["i"], block["w"], block["c"]))
    bounds = np.searchsorted([r[0] for r in order], np.arange(len(names) + 1))
    term = np.array([r[1] for r in order], np.int64)
    weight = np.array([r[2] for r in order], np.int64) * weights[term]
    shared = spark.sparkContext.broadcast((bounds, term, weight, len(vocabulary), top))
    strata = (
        forward.where("d IS NOT NULL").withColumn("m", F.expr(f"25L + (75L * n * {n}L) div {max(total, 1)}L")).select("d", "m", "t", "f")
        .repartitionByRange("m", F.xxhash64("d")).sortWithinPartitions("m")
    )
    best = strata.mapInArrow(_searched(shared), "k bigint, d bigint, score bigint")
    place = Window.partitionBy("k").orderBy(F.desc("score"), "d")
    ranked = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    keys = spark.createDataFrame([(k, int(i)) for k, i in enumerate(names)], "k bigint, i bigint")
    return ranked.join(F.broadcast(keys), "k").select("i", "rank", "d", "score")


def oracle(top: int = 10) -> str:
    """The same ranking in SQL."""
    word = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), {word})"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {split} AS words FROM documents WHERE text IS NOT NULL),
size AS (SELECT r, doc_id, len(words) AS n FROM d WHERE len(words) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
tf AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(words) AS w FROM d) GROUP BY r, w),
weight AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
           FROM tf CROSS JOIN total GROUP BY w, docs),
item AS (SELECT item_id, w, count(*) AS c FROM (SELECT item_id, unnest({split}) AS w FROM benchmark) GROUP BY item_id, w),
scored AS (
    SELECT item_id, doc_id, r,
           sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total.words))))::BIGINT AS score
    FROM item JOIN tf USING (w) JOIN weight USING (w) JOIN size USING (r) CROSS JOIN total
    GROUP BY item_id, doc_id, r)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
    FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
WHERE rank <= {top}"""
