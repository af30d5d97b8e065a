"""Operator 4: near-duplicate documents by a MinHash LSH forest.

Each distinct shingle set gets ``TREES`` labels of ``DEPTH`` MinHash values. Per tree, the labels are sorted; sets whose
labels share at least ``SHALLOW`` leading values form a region, and the depth that separates candidates adapts to it: a
region of up to ``SMALL`` sets gives all its pairs, a larger one is split by one value more, down to the whole label,
where neighbours in sorted order and the first set of the run are the partners. In a large region every set is
also compared with its hub, the set that lies most often in the commonest run over all trees, as the source of many
edited copies does. What this finds links most sets. The rest is exact: in a region of more than ``SMALL`` sets that
still holds several components, every set is held against every set of another one, by size, by all its MinHash values and then in
full, in tiles dealt over the tasks; see :func:`across`. Every link is confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import checked_join, components, pick, pieces
from stowline.llm.shingles import WordHashes, shingle_set
from stowline.session import cut_lineage

TREES, DEPTH, SHALLOW = 16, 8, 4
SMALL, NEAR = 16, 3
DEEP_ROWS = 20_000
WIDTH = 4 * DEPTH
TILE_LEFT, TILE_RIGHT, TILE_SHINGLES = 1024, 65_536, 4_000_000
TILE = ["tree", "part", "i", "j"]


def signature(shingles: np.ndarray, slopes: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(slopes), np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(values), 2048):
        block = slopes[:, None] * values[None, start:start + 2048]
        block += shifts[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return least


def signed(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(d, n, key, sig): set size, identity of the set and MinHash values of every row; key and sig null for empty sets."""
    draw = np.random.default_rng(11)
    slopes = draw.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = draw.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for some in pieces(batch, "t"):
                sizes, keys, signs = [], [], []
                for value in some.column("t").to_pylist():
                    found = shingle_set(value, size, words)
                    sizes.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    signs.append(signature(found, slopes, shifts).astype(">u4").tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [some.column("d"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
                    ["d", "n", "key", "sig"])

    return pick(docs, d=doc_id, t=text).mapInArrow(run, "d bigint, n bigint, key binary, sig binary")


def _region(labels: list[bytes], docs: list[int], at: int, end: int, depth: int, out: list[tuple[int, int]]) -> int:
    """Candidates of rows at..end, which share ``depth`` values; returns the least document."""
    first = min(docs[at:end])
    size = end - at
    if size <= SMALL:
        out += [(docs[i], docs[j]) for i in range(at, end) for j in range(i + 1, end)]
        return first
    if depth == DEPTH:
        out += [(docs[i], docs[j]) for i in range(at, end) for j in range(i + 1, min(i + 1 + NEAR, end))]
    else:
        cut, start = 4 * (depth + 1), at
        for i in range(at + 1, end + 1):
            if i == end or labels[i][:cut] != labels[start][:cut]:
                out.append((first, _region(labels, docs, start, i, depth + 1, out)))
                out.append((docs[i - 1], docs[i] if i < end else first))
                start = i
    out += [(first, d) for d in docs[at:end]]
    return first


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (tree, part, label, d) rows to candidates (a, b) and, for large regions, to (tree, part, d, vote) rows."""
    labels: list[bytes] = []
    docs: list[int] = []
    now: tuple | None = None
    made: list[tuple[int, int]] = []
    votes: list[tuple[int, bytes, int, int]] = []

    def close() -> None:
        if len(docs) > 1:
            depth = len(now[1]) // 4
            _region(labels, docs, 0, len(docs), depth, made)
            if len(docs) > SMALL:
                starts = [i for i in range(len(labels)) if i == 0 or labels[i] != labels[i - 1]] + [len(labels)]
                widest = max(range(len(starts) - 1), key=lambda i: starts[i + 1] - starts[i])
                votes.extend((now[0], now[1], d, int(starts[widest] <= i < starts[widest + 1])) for i, d in enumerate(docs))
        labels.clear()
        docs.clear()

    def emit() -> pa.RecordBatch:
        pairs = sorted({(min(p), max(p)) for p in made if p[0] != p[1]})
        n, m = len(pairs), len(votes)
        columns = [
            pa.array([p[0] for p in pairs] + [None] * m, pa.int64()), pa.array([p[1] for p in pairs] + [None] * m, pa.int64()),
            pa.array([None] * n + [v[0] for v in votes], pa.int32()), pa.array([None] * n + [v[1] for v in votes], pa.binary()),
            pa.array([None] * n + [v[2] for v in votes], pa.int64()), pa.array([None] * n + [v[3] for v in votes], pa.int32()),
        ]
        made.clear()
        votes.clear()
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "tree", "part", "d", "vote"])

    for batch in batches:
        for tree, part, label, d in zip(*(batch.column(c).to_pylist() for c in ("tree", "part", "label", "d"))):
            if (tree, part) != now or (len(docs) >= 2 * DEEP_ROWS and label != labels[-1]):
                close()
                now = tree, part
            elif len(docs) >= 2 * DEEP_ROWS:
                made.append((docs[0], d))
                made.append((docs[-1], d))
                docs[-1] = d
                if len(made) > 200_000:
                    yield emit()
                continue
            labels.append(label)
            docs.append(d)
        if len(made) + len(votes) > 100_000:
            yield emit()
    close()
    yield emit()


def candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to confirm first, which link large regions through their hubs, and all other pairs."""
    trees = sets.select("d", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "tree", "d", F.expr(f"substring(sig, tree * {WIDTH} + 1, {WIDTH})").alias("label"))
    rows = trees.withColumn("part", F.expr(f"substring(label, 1, {4 * SHALLOW})"))
    crowded = rows.groupBy("tree", "part").count().where(F.col("count") > DEEP_ROWS).select("tree", "part", F.lit(True).alias("deep"))
    rows = checked_join(rows, cut_lineage(crowded), ["tree", "part"]).select(
        "tree", F.when(F.col("deep"), F.col("label")).otherwise(F.col("part")).alias("part"), "label", "d")
    found = cut_lineage(
        rows.repartition("tree", "part").sortWithinPartitions("tree", "part", "label", "d")
        .mapInArrow(_scan, "a bigint, b bigint, tree int, part binary, d bigint, vote int")
    )
    pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
    members = found.where("d IS NOT NULL").select("tree", "part", "d", "vote")
    votes = members.groupBy("d").agg(F.sum("vote").alias("votes"))
    hubs = members.join(votes, "d").groupBy("tree", "part").agg(F.max_by("d", F.struct("votes", -F.col("d"))).alias("hub"))
    stars = members.join(hubs, ["tree", "part"]).where("d <> hub").select(
        F.least("d", "hub").alias("a"), F.greatest("d", "hub").alias("b")).distinct()
    firsts = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    return stars.unionByName(firsts).distinct(), pairs


def fewest_equal(percent: int) -> int:
    """Equal MinHash values below which sets can't be linked: five standard deviations under what linked ones expect."""
    n, p = TREES * DEPTH, percent / 100
    return max(0, math.floor(n * p - 5 * math.sqrt(n * p * (1 - p))))


def across(texts: DataFrame, sets: DataFrame, roots: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between sets of different components that share a region of more than ``SMALL`` sets.

    All that are needed to connect them, whatever the size of the region: its largest component is met by the sets of the others,
    which meet each other too. Both sides are cut into tiles by hash, of about ``TILE_LEFT`` and ``TILE_RIGHT`` sets, so no task
    holds a region. First only MinHash values meet; sets that then have a possible partner come again with their shingles and
    are compared in full inside their tile, in the first tree they share. So what is written follows the sets, not their pairs.
    """
    named = sets.join(roots.select(F.col("node").alias("d"), "root"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    named = cut_lineage(named.select("key", "d", "n", "sig", "root"))
    rows = named.select("key", "n", "root", F.posexplode(F.array(*[
        F.expr(f"substring(sig, {tree * WIDTH + 1}, {4 * SHALLOW})") for tree in range(TREES)])).alias("tree", "part"))
    crowded = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where(
        f"m > {SMALL} AND low <> high").select("tree", "part")
    inside = cut_lineage(checked_join(rows, cut_lineage(crowded), ["tree", "part"], "inner"))
    by_root = inside.groupBy("tree", "part", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    largest = by_root.groupBy("tree", "part").agg(
        F.max_by(F.struct("root", "k", "w"), F.struct("k", "root")).alias("main"), F.sum("k").alias("m"), F.sum("w").alias("w"))
    lefts = F.ceil(F.greatest((F.col("m") - F.col("main.k")) / TILE_LEFT, (F.col("w") - F.col("main.w")) / TILE_SHINGLES))
    shape = cut_lineage(largest.select("tree", "part", F.col("main.root").alias("main"), lefts.cast("int").alias("lefts"),
                                       F.ceil(F.col("m") / TILE_RIGHT).cast("int").alias("rights")))
    placed = checked_join(inside.select("tree", "part", "key", "root"), shape, ["tree", "part"], "inner")
    left, right = F.pmod(F.xxhash64("key"), F.col("lefts")).cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("rights")).cast("int")
    probes = placed.where("root <> main").select(
        "tree", "part", left.alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), F.lit(0).alias("side"), "key")
    others = placed.select(
        "tree", "part", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), right.alias("j"), F.lit(1).alias("side"), "key")
    trees = inside.groupBy("key").agg(F.sum(F.expr("shiftleft(1, tree)")).alias("trees"))
    named = cut_lineage(named.join(trees, "key"))
    least = fewest_equal(percent)

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for tile, side, some in _slices(batches):
            if tile != now:
                yield from (keep.filter(pa.array(mark)) for _, keep, mark in held)
                now, held = tile, []
            part, keep, mark = _part(some), some.select([*TILE, "side", "key"]), np.zeros(some.num_rows, bool)
            if side == 0:
                held.append((part, keep, mark))
                continue
            for probe, _, found in held:
                for x, y in _near(probe, part, tile[0], least, percent):
                    found[x] = mark[y] = True
            yield keep.filter(pa.array(mark))
        yield from (keep.filter(pa.array(mark)) for _, keep, mark in held)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, above = None, [], {}
        for tile, side, some in _slices(batches):
            if tile != now:
                now, held, above = tile, [], {}
            part, shingles = _part(some), [np.frombuffer(s, np.uint64) for s in some.column("shingles").to_pylist()]
            if side == 0:
                held.append((part, shingles))
                continue
            out = []
            for probe, own in held:
                for x, y in _near(probe, part, tile[0], least, percent):
                    for i, j in _linked(own, shingles, x, y, percent):
                        if _join(above, int(probe[3][i]), int(part[3][j])):
                            out.append(sorted((int(probe[1][i]), int(part[1][j]))))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def met(tiles: DataFrame, sides: DataFrame) -> DataFrame:
        return tiles.join(sides, "key").repartition(*TILE).sortWithinPartitions(*TILE, "side")

    near = cut_lineage(met(probes.unionByName(others), named).mapInArrow(partners, "tree int, part binary, i int, j int, side int, key binary"))
    few = cut_lineage(named.join(near.select("key").distinct(), "key", "left_semi"))
    whole = shingled(checked_join(texts, cut_lineage(few.select("d").distinct()), ["d"], "left_semi"), size).dropDuplicates(["d", "key"])
    return met(near, few.join(whole, ["d", "key"])).mapInArrow(links, "a bigint, b bigint").distinct()


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """(d, key, shingles) of rows of (d, t) with words: the whole set and its identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for some in pieces(batch, "t"):
                found = [shingle_set(value, size, words).tobytes() for value in some.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("d"), pa.array([xxhash.xxh3_128_digest(f) if f else None for f in found], pa.binary()), pa.array(found, pa.binary())],
                    ["d", "key", "shingles"])

    return docs.select("d", "t").mapInArrow(run, "d bigint, key binary, shingles binary").where("key IS NOT NULL")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """(tile, side, rows) of batches sorted by tile and side; one side of a tile may come in several slices."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in (*TILE, "side"))))
        start = 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[start]:
                yield keys[start][:-1], keys[start][-1], batch.slice(start, end - start)
                start = end


def _part(some: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """MinHash values, ids, sizes, roots and crowded trees (as bits) of the rows."""
    sig = np.frombuffer(b"".join(some.column("sig").to_pylist()), ">u4").reshape(-1, TREES * DEPTH)
    return sig, *(some.column(c).to_numpy(zero_copy_only=False) for c in ("d", "n", "root", "trees"))


def _near(left: tuple, right: tuple, tree: int, least: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of two parts that are of different components, close in size and in MinHash values, and share no
    crowded region of an earlier tree, where they meet already."""
    heads = np.arange(TREES * DEPTH).reshape(TREES, DEPTH)[:tree, :SHALLOW].ravel()
    for i in range(0, len(left[0]), 64):
        sig, _, n, root, trees = (x[i:i + 64] for x in left)
        for j in range(0, len(right[0]), 256):
            sig2, _, n2, root2, _ = (x[j:j + 256] for x in right)
            may = (root[:, None] != root2) & (np.minimum(n[:, None], n2) * 100 >= percent * np.maximum(n[:, None], n2))
            if not may.any():
                continue
            may &= (sig[:, None, :] == sig2).sum(axis=2) >= least
            x, y = np.nonzero(may)
            if tree:
                same = (sig[x][:, heads] == sig2[y][:, heads]).reshape(len(x), tree, SHALLOW).all(axis=2)
                new = ~(same & (trees[x][:, None] >> np.arange(tree) & 1).astype(bool)).any(axis=1)
                x, y = x[new], y[new]
            if len(x):
                yield x + i, y + j


def _linked(own: list[np.ndarray], others: list[np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """The pairs of positions, sorted by ``x``, whose whole sets reach ``percent``: intersection against union."""
    edges = [0, *(np.flatnonzero(np.diff(x)) + 1), len(x)]
    for start, end in zip(edges, edges[1:]):
        held, many = own[x[start]], [others[j] for j in y[start:end]]
        sizes = np.array([len(s) for s in many])
        flat = np.concatenate(many)
        hit = held[np.minimum(np.searchsorted(held, flat), len(held) - 1)] == flat
        both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
        for at in np.flatnonzero((both > 0) & (100 * both >= percent * (len(held) + sizes - both))):
            yield int(x[start]), int(y[start + at])


def _join(above: dict[int, int], a: int, b: int) -> bool:
    """Make two components one; False if they are one already. ``above`` leads from a component towards the one it is in."""
    a, b = (_top(above, r) for r in (a, b))
    if a != b:
        above[max(a, b)] = min(a, b)
    return a != b


def _top(above: dict[int, int], r: int) -> int:
    while r in above:
        above[r] = above.get(above[r], above[r])
        r = above[r]
    return r


def confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of rows of (d, t) whose sets reach ``percent``: intersection against union, on whole texts."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct()
    texts = checked_join(docs, cut_lineage(named), ["d"], "left_semi")
    joined = (
        pairs.join(texts.select(F.col("d").alias("b"), F.col("t").alias("tb")), "b")
        .join(texts.select(F.col("d").alias("a"), F.col("t").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        last, held = None, None
        for batch in batches:
            for some in pieces(batch, "tb"):
                left, right = [], []
                for i, (a, b, tb) in enumerate(zip(*(some.column(c).to_pylist() for c in ("a", "b", "tb")))):
                    ta = some.column("ta")[i].as_py()
                    if ta != last:
                        last, held = ta, shingle_set(ta, size, words)
                    other = shingle_set(tb, size, words)
                    if min(len(held), len(other)) * 100 < percent * max(len(held), len(other)):
                        continue
                    both = len(np.intersect1d(held, other, assume_unique=True))
                    if both and 100 * both >= percent * (len(held) + len(other) - both):
                        left.append(a)
                        right.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; documents are linked when 100 * intersection >= percent * union.

    Equal sets fall into one class before any comparison, so exact copies cost one row each. Links that already
    connect two sets spare the candidates between them; no link between different components is left out.
    Null, empty and blank texts have no shingle and are linked with nothing; a text of fewer words than ``size`` is one
    shingle; rows that share an id share its component; a row without id has a null component and is kept; an empty
    table gives an empty one; other columns are ignored. Texts are read whole.
    """
    own = pick(docs, d=doc_id, t=text)
    rows = cut_lineage(signed(docs, size, doc_id, text))
    known = rows.where("key IS NOT NULL AND d IS NOT NULL")
    classes = cut_lineage(known.groupBy("key").agg(F.min("d").alias("rep")))
    sets = cut_lineage(known.join(classes.withColumnRenamed("rep", "d"), ["key", "d"]).select("d", "key", "n", "sig").dropDuplicates())
    first, rest = candidates(sets)
    texts = own.where("d IS NOT NULL")
    strong = cut_lineage(confirmed(texts, cut_lineage(first), size, percent))
    roots = components(strong)
    open_pairs = (
        rest.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        .join(first, ["a", "b"], "left_anti")
    )
    strong = cut_lineage(strong.unionByName(confirmed(texts, cut_lineage(open_pairs), size, percent)))
    more = across(texts, sets, components(strong), size, percent)
    copies = known.join(classes, "key").where("d <> rep").select(F.col("rep").alias("a"), F.col("d").alias("b"))
    root = components(strong.unionByName(more).unionByName(copies))
    joined = rows.select("d", "n").join(root.withColumnRenamed("node", "d"), "d", "left")
    component = F.coalesce("root", "d")
    return joined.select(F.col("d").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(component == F.col("d"), F.lit(True)).alias("kept"))


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone``, which holds each id once; rows without id stay.

    Rows that repeat a kept id share its component and stay with it.
    """
    return checked_join(docs, gone.select(F.col(gone.columns[0]).alias(doc_id)), [doc_id], "left_anti").select(*docs.columns)
