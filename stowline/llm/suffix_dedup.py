"""Operator 8: repeated strings of ``length`` bytes, by longest-previous-factor arrays over the suffix order.

A suffix array of all bytes at once would have to sit in one place. Instead every string of ``length`` bytes is sent,
with its start, to the anchor that it contains for sure: its k-gram of least hash. Equal strings hold equal anchors at
equal offsets, so they meet, and only anchors seen twice are followed up. Where they meet, the starts are put in suffix
order, truncated at ``length`` bytes with ties in text order; among the starts with one prefix, the previous smaller
position is then the entry before, and a start whose longest previous factor reaches ``length`` is a later copy, its
source a first one. No string is cut, sampled or left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import checked_join, pick, pieces
from stowline.llm.shingles import mixed
from stowline.session import cut_lineage

BLOCK = 1 << 20
SUFFIX_BYTES = 3 << 20
HASHED_STARTS = 4_000_000
_INDEX = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15
_values = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n``."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        _powers[size] = out[0], out[1]
    return _powers[size]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each string of ``width`` bytes."""
    up, down = powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_values[data] * up[: len(data)], dtype=np.uint64)])
    return mixed((total[width:] - total[:-width]) * down[: len(data) - width + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): runs of starts that share an anchor; ``ends``: for each byte, the end of its text."""
    hashes = rolling(data, gram)
    packed = (hashes & ~_INDEX) | np.arange(len(hashes), dtype=np.uint64)
    least = (sliding_min(packed, length - gram + 1) & _INDEX).astype(np.int64)
    starts = np.flatnonzero(np.arange(len(least)) + length <= ends[: len(least)])
    at = least[starts]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | (ends[starts[1:]] != ends[starts[:-1]])])
    return hashes[at[new]], starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]]


def _indexed(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "x", BLOCK):
                keep: list[tuple[int, int, bytes]] = []
                for t, x in zip(some.column("t").to_pylist(), some.column("x").to_pylist()):
                    body = x.encode() if x else b""
                    for at in range(0, max(len(body) - length + 1, 0), BLOCK):
                        keep.append((t, at, body[at:at + BLOCK + length - 1]))
                held: list[tuple[int, int, bytes]] = []
                size = 0
                for n, part in enumerate(keep):
                    held.append(part)
                    size += len(part[2])
                    if size >= BLOCK or n == len(keep) - 1:
                        yield _anchor_rows(held, length, gram)
                        held, size = [], 0

    return run


def _anchor_rows(held: list[tuple[int, int, bytes]], length: int, gram: int) -> pa.RecordBatch:
    sizes = np.array([len(b) for _, _, b in held])
    stop = np.cumsum(sizes)
    data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
    hashes, first, last = anchors(data, np.repeat(stop, sizes), length, gram)
    owner = np.searchsorted(stop, first, side="right")
    shift = np.array([at for _, at, _ in held]) - (stop - sizes)
    texts = np.array([t for t, _, _ in held], np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes.view(np.int64)), pa.array(texts[owner]), pa.array(first + shift[owner]), pa.array(last + shift[owner])],
        ["h", "t", "lo", "hi"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, those whose h is not alone."""
    held: pa.RecordBatch | None = None
    before = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        h = rows.column("h").to_numpy()
        same = np.r_[before == h[0], h[1:] == h[:-1]]
        after = np.r_[h[1:] == h[:-1], False]
        yield rows.slice(0, len(h) - 1).filter(pa.array((same | after)[:-1]))
        before = h[-2] if len(h) > 1 else before
        held = rows.slice(len(h) - 1)
    if held is not None and before == held.column("h")[0].as_py():
        yield held


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "x", BLOCK):
                rows: list[tuple] = []
                for t, d, x, found in zip(*(some.column(c).to_pylist() for c in ("t", "d", "x", "found"))):
                    body = x.encode()
                    rows += [(p["h"], d, t, p["lo"], body[p["lo"]:p["hi"] + length]) for p in found]
                    if len(rows) > 5000:
                        yield _table(rows)
                        rows = []
                if rows:
                    yield _table(rows)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h", "d", "t", "lo", "body"])


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position in the order of suffixes truncated at ``length`` bytes; equal prefixes share a rank."""
    n = len(data)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(min(8, length)):
        key = (key << np.uint64(8)) | wide[i:i + n]
    _, rank = np.unique(key, return_inverse=True)
    have = min(8, length)
    while have < length:
        step = min(have, length - have)
        other = np.zeros(n, np.int64)
        other[: max(n - step, 0)] = rank[step:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (n + 2) + other, return_inverse=True)
        have += step
    return rank


def previous_factors(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, source): whether the longest previous factor of each position reaches the full length, and whether
    the position is the source of one. Positions count in the order given; within a rank, the previous smaller
    position in suffix order is the entry before."""
    order = np.argsort(rank, kind="stable")
    same = rank[order][1:] == rank[order][:-1]
    later = np.zeros(len(rank), bool)
    source = np.zeros(len(rank), bool)
    later[order[1:][same]] = True
    source[order[:-1][same]] = True
    return later, source


def _starts(rows: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of contexts (t, lo, body), equal bodies once, and for each start its place in them, its text and its place in that."""
    number: dict[bytes, int] = {}
    own = np.array([number.setdefault(r[2], len(number)) for r in rows])
    data = np.frombuffer(b"".join(number), np.uint8)
    sizes = np.array([len(body) for body in number])
    begin = (np.cumsum(sizes) - sizes)[own]
    counts = sizes[own] - length + 1
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.repeat(np.arange(len(rows)), counts)
    texts, first = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    return data, begin[owner] + inner, texts[owner], first[owner] + inner


def _spans(rank: np.ndarray, texts: np.ndarray, places: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of repeated starts as covered byte ranges."""
    later, source = previous_factors(rank)
    at = np.flatnonzero(later | source)
    new = np.flatnonzero(np.r_[True, (texts[at][1:] != texts[at][:-1]) | (places[at][1:] != places[at][:-1] + 1)
                               | (later[at][1:] != later[at][:-1])]) if len(at) else at
    last = np.r_[new[1:] - 1, len(at) - 1] if len(at) else at
    return pa.RecordBatch.from_arrays(
        [pa.array(texts[at][new]), pa.array(places[at][new]), pa.array(places[at][last] + length), pa.array(later[at][new])],
        ["t", "s", "e", "later"])


def _matched(length: int):
    """Contexts sorted by (h, d, t, lo) to covered byte ranges.

    Whole groups are put in suffix order together, a few megabytes at once. Of a group too large for that, only one
    64-bit hash a start is held, up to ``HASHED_STARTS``; groups beyond don't come here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        group: list[tuple] = []
        hashed: list[tuple[np.ndarray, ...]] = []
        now, group_size, ready_size = None, 0, 0

        def reduce() -> None:
            data, at, texts, places = _starts(group, length)
            hashed.append((rolling(data, length)[at], texts, places))
            group.clear()

        def close() -> Iterator[pa.RecordBatch]:
            if hashed:
                if group:
                    reduce()
                hashes, texts, places = (np.concatenate(c) for c in zip(*hashed))
                hashed.clear()
                yield _spans(hashes, texts, places, length)
            ready.extend(group)
            group.clear()

        def flush() -> pa.RecordBatch:
            data, at, texts, places = _starts(ready, length)
            ready.clear()
            return _spans(suffix_ranks(data, length)[at], texts, places, length)

        for batch in batches:
            for h, t, lo, body in zip(*(batch.column(c).to_pylist() for c in ("h", "t", "lo", "body"))):
                if h != now:
                    ready_size += group_size
                    yield from close()
                    if ready and ready_size > SUFFIX_BYTES // 2:
                        yield flush()
                        ready_size = 0
                    now, group_size = h, 0
                group.append((t, lo, body))
                group_size += len(body)
                if group_size > SUFFIX_BYTES:
                    reduce()
                    group_size = 0
        yield from close()
        if ready:
            yield flush()

    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "body", BLOCK):
                rows = [*zip(*(some.column(c).to_pylist() for c in ("t", "lo", "body")))]
                data, at, texts, places = _starts(rows, length)
                owner = np.repeat(np.arange(len(rows)), [len(r[2]) - length + 1 for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rolling(data, length)[at].view(np.int64)), some.column("d").take(pa.array(owner)), pa.array(texts), pa.array(places)],
                    ["w", "d", "t", "s"])

    return run


def repeated_spans(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(t, s, e, later) byte ranges of distinct texts (d, t, x) that a string of ``length`` bytes found twice covers.

    ``later`` marks copies that have an earlier one, by (d, t, place). Ranges may overlap.
    """
    rows = texts.select("t", "x").mapInArrow(_indexed(length, gram), "h bigint, t bigint, lo bigint, hi bigint")
    found = cut_lineage(
        rows.repartition("h").sortWithinPartitions("h").mapInArrow(_repeated, "h bigint, t bigint, lo bigint, hi bigint")
    )
    hot = cut_lineage(found.groupBy("h").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n")).where(F.col("n") > HASHED_STARTS).select("h"))

    def contexts(part: DataFrame) -> DataFrame:
        grouped = cut_lineage(part.groupBy("t").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("found")))
        some = checked_join(texts, grouped.select("t"), ["t"], "left_semi")
        return some.join(grouped, "t").select("t", "d", "x", "found").mapInArrow(
            _contexts(length), "h bigint, d bigint, t bigint, lo bigint, body binary")

    spans = (
        contexts(checked_join(found, hot, ["h"], "left_anti")).repartition("h").sortWithinPartitions("h", "d", "t", "lo")
        .mapInArrow(_matched(length), "t bigint, s bigint, e bigint, later boolean")
    )
    if hot.isEmpty():
        return spans
    windows = cut_lineage(contexts(checked_join(found, hot, ["h"], "left_semi")).mapInArrow(_window_hashes(length), "w bigint, d bigint, t bigint, s bigint"))
    place = F.struct(F.coalesce("d", F.lit(-(1 << 63))).alias("d"), "t", "s")
    twice = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("w", "first")
    more = windows.join(twice, "w").select("t", "s", (F.col("s") + length).alias("e"), (place != F.col("first")).alias("later"))
    return spans.unionByName(more)


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "x", BLOCK):
                sizes, counts, shas, kepts = [], [], [], []
                for x, found in zip(some.column("x").to_pylist(), some.column("found").to_pylist()):
                    body = x.encode()
                    kept, end, runs, removed = [], 0, 0, 0
                    begin = None
                    for p in sorted((p["s"], p["e"]) for p in found):
                        if begin is None or p[0] > end:
                            kept.append(body[end:p[0]])
                            runs += 1
                            begin = p[0]
                            removed += p[1] - p[0]
                            end = p[1]
                        elif p[1] > end:
                            removed += p[1] - end
                            end = p[1]
                    kept.append(body[end:])
                    rest = b"".join(kept)
                    sizes.append(removed)
                    counts.append(runs)
                    shas.append(hashlib.sha256(rest).hexdigest())
                    kepts.append(rest if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [some.column("d"), pa.array([len(x.encode()) for x in some.column("x").to_pylist()], pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(kepts, pa.binary())],
                    ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, gram: int | None = None, keep_first: bool = False, with_text: bool = False,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and the kept bytes if ``with_text``, one row per row.

    Removed is each UTF-8 byte covered by a string of ``length`` bytes that starts somewhere else too, judged on the
    input; with ``keep_first`` only by one that starts earlier, in the order of doc_id. Matches don't cross rows.
    Equal texts are indexed once: with two or more copies each of their strings is found elsewhere. Null and empty
    texts have no bytes and lose none; null ids are kept (and come first); repeated rows are copies of each other;
    an empty table gives an empty one; other columns are ignored. Texts are told apart by 64-bit hashes.
    """
    gram = gram or max(1, length // 2)
    own = pick(docs, d=doc_id, x=text).select(F.col("d").cast("bigint").alias("d"), F.coalesce("x", F.lit("")).alias("x"))
    own = own.withColumn("t", F.xxhash64("x"))
    copies = cut_lineage(own.select("d", "t", F.octet_length("x").alias("n")).where(F.col("n") >= length)
                         .groupBy("t").agg(F.count(F.lit(1)).alias("copies"), F.min("d").alias("rep")))
    many = copies.where("copies > 1").select("t", "rep", "copies")
    named = checked_join(own, many, ["t"])
    chosen = named.where(F.col("copies").isNull() | (F.col("d") == F.col("rep")) | F.col("rep").isNull()).select("d", "t", "x")
    spans = repeated_spans(chosen.where(F.octet_length("x") >= length), length, gram)
    if keep_first:
        spans = spans.where("later")
    gathered = cut_lineage(spans.select("t", "s", "e").groupBy("t").agg(F.collect_list(F.struct("s", "e")).alias("found")))
    whole = F.col("copies").isNotNull() & (F.lit(not keep_first) | (F.col("d") != F.col("rep")))
    gone = named.where(whole).select("d", F.octet_length("x").cast("bigint").alias("n_bytes"), F.octet_length("x").cast("bigint").alias("n_removed"),
                                     F.lit(1).cast("bigint").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").cast("binary").alias("kept"))
    rest = named.where(~whole).select("d", "t", "x")
    cut = checked_join(rest, gathered.select("t"), ["t"], "left_semi").join(gathered, "t").select("d", "x", "found").mapInArrow(
        _cut(with_text), "d bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    same = checked_join(rest, gathered.select("t"), ["t"], "left_anti").select(
        "d", F.octet_length("x").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2(F.col("x").cast("binary"), 256).alias("kept_sha256"), F.col("x").cast("binary").alias("kept"))
    out = gone.unionByName(cut).unionByName(same).withColumnRenamed("d", doc_id)
    return out if with_text else out.drop("kept")
