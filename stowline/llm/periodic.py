"""Operator 12: periodic runs of words, by internal pattern matching over a suffix array with a wavelet tree.

A run of smallest period q and length max(6, 4 * q) or more holds, for the dyadic length b with q <= b < 2q (4 at least),
a whole block of b words that begins at a multiple of b / 2, together with its shift by q: 3 * q >= b + b / 2 - 1.
As b reaches a whole primitive period, the block's next occurrence inside the run is exactly q ahead. So each block asks
once for its next occurrence in the window of b starts after its own: its occurrences are one interval of the suffix
array, and the wavelet tree over that array answers the range successor. The distances found, which the progression of a
run repeats from block to block, are the candidate periods; each is then extended word by word to its maximal runs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stowline.llm.common import pick, pieces

CHUNK_BYTES = 1 << 20
LEAST = 4


class WaveletTree:
    """Counts and order statistics over any interval of an array of numbers below ``2**levels``, levels packed by bits."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        now = values
        for bit in range(levels - 1, -1, -1):
            ones = (now >> bit & 1).astype(bool)
            padded = np.zeros((len(now) // 64 + 1) * 64, bool)
            padded[: len(now)] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1]
            self.levels.append((bit, packed, before, len(now) - int(ones.sum())))
            now = np.concatenate([now[~ones], now[ones]])

    @staticmethod
    def _ones(level: tuple[int, np.ndarray, np.ndarray, int], at: np.ndarray) -> np.ndarray:
        _, packed, before, _ = level
        word = at >> 6
        inside = packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[word] + np.bitwise_count(inside)

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values of [low, high) are less than the limit."""
        found = np.zeros(len(low), np.int64)
        for level in self.levels:
            bit, _, _, zeros = level
            a, b = self._ones(level, low), self._ones(level, high)
            up = (limit >> bit & 1).astype(bool)
            found += np.where(up, (high - b) - (low - a), 0)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return found

    def select(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value (from 0) of [low, high)."""
        found = np.zeros(len(low), np.int64)
        for level in self.levels:
            bit, _, _, zeros = level
            a, b = self._ones(level, low), self._ones(level, high)
            clear = (high - b) - (low - a)
            up = k >= clear
            k = np.where(up, k - clear, k)
            found |= up.astype(np.int64) << bit
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return found

    def successor(self, low: np.ndarray, high: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The least value of [low, high) greater than ``after``, or -1."""
        less = self.below(low, high, after + 1)
        out = np.full(len(low), -1, np.int64)
        some = np.flatnonzero(less < high - low)
        if len(some):
            out[some] = self.select(low[some], high[some], less[some])
        return out


def _refine(rank: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank (the first place of its class) by twice the prefix; classes of one place stay as they are."""
    n = len(rank)
    ahead = np.zeros(n, np.int64)
    ahead[: max(n - shift, 0)] = rank[shift:] + 1
    key = rank * (n + 1) + ahead
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.empty(n, np.int64)
    out[order] = np.repeat(new, np.diff(np.r_[new, n]))
    return order, out


def candidates(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows (text, period) of candidate periods; ``words`` are numbers, ``owner`` ascends, texts don't meet."""
    if not len(words):
        return np.empty((0, 2), np.int64)
    # A word is told apart by its text, so that classes hold places of one text only.
    _, dense = np.unique(owner * (int(words.max()) + 1) + words, return_inverse=True)
    sizes = np.bincount(dense)
    rank = (np.cumsum(sizes) - sizes)[dense]
    for shift in (1, 2):
        _, rank = _refine(rank, shift)
    again = np.bincount(rank, minlength=len(rank))[rank] > 1
    again[_short(owner, LEAST)] = False
    keep = np.isin(owner, np.unique(owner[again]))
    if not keep.any():
        return np.empty((0, 2), np.int64)
    owner, dense = owner[keep], dense[keep]
    sizes = np.bincount(dense)
    rank = (np.cumsum(sizes) - sizes)[dense]
    n = len(owner)
    _, begins, lengths = np.unique(owner, return_index=True, return_counts=True)
    inner = np.arange(n) - np.repeat(begins, lengths)
    left = np.repeat(begins + lengths, lengths) - np.arange(n)
    asked: list[tuple[np.ndarray, ...]] = []
    size, order = 1, None
    longest = int(lengths.max())
    while size < longest:
        order, rank = _refine(rank, size)
        size *= 2
        if size >= LEAST:
            at = np.flatnonzero((inner % (size // 2) == 0) & (left >= size))
            many = np.bincount(rank, minlength=n)
            at = at[many[rank[at]] > 1]
            low = rank[at]
            asked.append((at, low, low + many[low], np.full(len(at), size)))
        if np.bincount(rank).max() == 1:
            break
    if order is None or not asked:
        return np.empty((0, 2), np.int64)
    at, low, high, size_of = (np.concatenate(x) for x in zip(*asked))
    tree = WaveletTree(order, max(int(n - 1).bit_length(), 1))
    after = tree.successor(low, high, at)
    near = (after >= 0) & (after - at <= size_of)
    return np.unique(np.c_[owner[at[near]], (after - at)[near]], axis=0)


def _short(owner: np.ndarray, length: int) -> np.ndarray:
    """Places with fewer than ``length`` words of their text from there on."""
    n = len(owner)
    out = np.ones(n, bool)
    out[: max(n - length + 1, 0)] = owner[length - 1:] != owner[: max(n - length + 1, 0)]
    return out


def runs_of(words: np.ndarray, periods: np.ndarray, times: int, least: int) -> list[tuple[int, int, int]]:
    """Maximal runs (start, length, smallest period) of one text among the candidate periods."""
    found: dict[tuple[int, int], int] = {}
    for q in sorted(int(p) for p in periods):
        if q >= len(words):
            continue
        same = np.r_[False, words[q:] == words[:-q], False]
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for begin, end in edges[edges[:, 1] - edges[:, 0] + q >= max(least, times * q)].tolist():
            found.setdefault((begin, end - begin + q), q)
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2]))


def text_runs(bodies: list[list[bytes]], times: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """Runs of each of the texts, given as words."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    lengths = np.array([len(b) for b in bodies], np.int64)
    flat = np.fromiter((numbers[w] for b in bodies for w in b), np.int64, int(lengths.sum()))
    stops = np.cumsum(lengths)
    out: list[list[tuple[int, int, int]]] = [[] for _ in bodies]
    found = candidates(flat, np.repeat(np.arange(len(bodies)), lengths))
    texts, first = np.unique(found[:, 0], return_index=True)
    for text, begin, end in zip(texts.tolist(), first.tolist(), [*first[1:].tolist(), len(found)]):
        own = flat[stops[text] - lengths[text]:stops[text]]
        out[text] = runs_of(own, found[begin:end, 1], times, least)
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties go to the smallest start, then the smallest period."""
    best = None
    for start, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = start, length, q
    return best


FIELDS = {
    "n_runs": (pa.int64(), "bigint"), "runs": (pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])),
                                               "array<struct<start:bigint,length:bigint,period:bigint>>"),
    "start": (pa.int64(), "bigint"), "length": (pa.int64(), "bigint"), "period": (pa.int64(), "bigint"),
    "exponent_milli": (pa.int64(), "bigint"), "collapsed": (pa.string(), "string"),
    "runs_sha256": (pa.string(), "string"), "collapsed_sha256": (pa.string(), "string"),
}


def periodic_runs(docs: DataFrame, outputs: tuple[str, ...] = ("n_runs", "runs", "collapsed"), times: int = 4, least: int = 6,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of words in each whole text: stretches whose words repeat with a smallest period q, at least ``times`` * q and
    ``least`` words long, that no neighbouring word extends; one row per row.

    ``outputs`` are among n_runs, runs (by start, then period), start, length, period and exponent_milli of the run of
    greatest length / period (ties: smallest start, then period; null without a run), collapsed (the text without the
    words that a run holds after its first period, joined by blanks) and the lowercase-hex sha256 of the runs' lines
    ``start,length,period`` and of the collapsed text. ``times`` is 4 at least, ``least`` 6 at least. Null, empty and blank
    texts have no words and no run; null ids are kept; repeated rows give equal rows; an empty table gives an empty one;
    other columns are ignored. One map without a shuffle; a task holds about 1 MB of texts, or one longer text, at once.
    """
    if times < 4 or least < 6:
        raise ValueError("runs need times >= 4 and least >= 6")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "t", CHUNK_BYTES):
                bodies = [t.encode().split() if t else [] for t in some.column("t").to_pylist()]
                rows: dict[str, list] = {name: [] for name in outputs}
                for words, found in zip(bodies, text_runs(bodies, times, least)):
                    best = strongest(found)
                    start, length, q = best or (None, None, None)
                    short = collapse(words, found)
                    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
                    made = {
                        "n_runs": len(found), "runs": [dict(zip(("start", "length", "period"), r)) for r in found], "start": start,
                        "length": length, "period": q, "exponent_milli": 1000 * length // q if best else None,
                        "collapsed": short, "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
                        "collapsed_sha256": hashlib.sha256(short).hexdigest(),
                    }
                    for name in outputs:
                        rows[name].append(made[name].decode() if name == "collapsed" else made[name])
                columns = [pa.array(rows[name], type=FIELDS[name][0]) for name in outputs]
                yield pa.RecordBatch.from_arrays([some.column("d"), *columns], [doc_id, *outputs])

    schema = ", ".join([f"`{doc_id}` {kind}", *[f"{name} {FIELDS[name][1]}" for name in outputs]])
    return pick(docs, d=doc_id, t=text).mapInArrow(run, schema)
