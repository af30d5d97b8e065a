"""Operator 1: nearest neighbours by cosine over balanced posting lists.

Unit vectors of a bounded sample are split by 2-means until every cell is small, which balances the lists. A vector goes
to its nearest list and, if it lies near a boundary, to others within ``CLOSURE`` times that distance, unless a list
already chosen is nearer to the other centroid than the vector is. Centroids are found through a neighbour graph held
in memory. A query reads the lists within ``RATIO`` times its least centroid distance; their vectors are compared in
double precision, as blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowline.llm.common import pick
from stowline.session import cut_lineage

SAMPLE = 20_000
CELL = 64
MOST_LISTS = 2048
DEGREE = 24
BEAM = 64
COPIES, CLOSURE = 4, 1.15
RATIO, LEAST_LISTS = 1.4, 16
#: At most so many lists are read, or a fifth of all if that is more.
PROBES, PROBE_SHARE = 128, 5
PART_ROWS, CHUNK_ROWS = 5000, 2000


@dataclass
class Lists:
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of about the ``beam`` nearest centroids of each row, by best-first search of the graph.

        All rows advance together: each expands its nearest unexpanded centroid until none of the beam is left.
        """
        rows, count = len(x), len(self.centroids)
        beam = min(beam, count)
        seen = np.full((rows, count), np.inf)
        done = np.zeros((rows, count), bool)
        seen[:, self.entries] = self._distance(x[:, None, :], self.centroids[None, self.entries])
        active = np.arange(rows)
        while len(active):
            part = np.where(done[active], np.inf, seen[active])
            best = part.argmin(axis=1)
            near = part[np.arange(len(active)), best]
            bound = np.partition(seen[active], beam - 1, axis=1)[:, beam - 1]
            go = np.isfinite(near) & (near <= bound)
            active, best = active[go], best[go]
            if not len(active):
                break
            done[active, best] = True
            links = self.graph[best]
            at = active[:, None]
            found = self._distance(x[active][:, None, :], self.centroids[links])
            seen[at, links] = found
        order = np.argsort(seen, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(seen, order, axis=1)

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((a - b) ** 2).sum(-1), 0))

    def homes(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, list): the nearest list and the boundary copies."""
        order, far = self.nearest(x, 4 * COPIES)
        gaps = np.sqrt(np.maximum(2 - 2 * self.centroids @ self.centroids.T, 0)) if len(self.centroids) <= 4096 else None
        for row in range(len(x)):
            chosen = [order[row, 0]]
            for number, d in zip(order[row, 1:], far[row, 1:]):
                if len(chosen) == COPIES or d > CLOSURE * far[row, 0]:
                    break
                if all(gaps[number, c] >= d for c in chosen):
                    chosen.append(number)
            for number in chosen:
                yield row, int(number)

    def routes(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, list): lists within the distance ratio, the nearest ``LEAST_LISTS`` in any case."""
        order, far = self.nearest(x, max(PROBES, len(self.centroids) // PROBE_SHARE))
        take = (far <= RATIO * far[:, :1]) & np.isfinite(far)
        take[:, :LEAST_LISTS] = np.isfinite(far[:, :LEAST_LISTS])
        for row, at in zip(*np.nonzero(take)):
            yield int(row), int(order[row, at])


def build(sample: np.ndarray, lists: int) -> Lists:
    """Balanced cells of unit vectors by repeated 2-means of the largest cell, and the graph over their centroids."""
    draw = np.random.default_rng(5)
    cells = [np.arange(len(sample))]
    while len(cells) < lists:
        cells.sort(key=len)
        big = cells.pop()
        if len(big) < 2:
            cells.append(big)
            break
        x = sample[big]
        two = x[draw.choice(len(x), 2, replace=False)]
        for _ in range(8):
            side = x @ (two[1] - two[0])
            cut = np.argsort(side, kind="stable")
            halves = cut[: len(x) // 2], cut[len(x) // 2:]
            two = np.array([x[h].mean(axis=0) for h in halves])
        cells += [big[halves[0]], big[halves[1]]]
    centroids = np.array([sample[c].mean(axis=0) for c in cells])
    norms = np.linalg.norm(centroids, axis=1, keepdims=True)
    centroids = np.where(norms > 1e-9, centroids / np.maximum(norms, 1e-9), centroids)
    near = np.argsort(-(centroids @ centroids.T), axis=1, kind="stable")
    count = len(centroids)
    close = near[:, 1:1 + DEGREE]
    far = draw.integers(0, count, (count, 4))
    ring = (np.arange(count)[:, None] + 1) % count
    return Lists(centroids, np.concatenate([close, far, ring], axis=1), draw.choice(count, min(8, count), replace=False))


def _valid(df: DataFrame) -> DataFrame:
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select("id", F.col("v").cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(usable)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(index, method: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                pairs = [*getattr(index.value, method)(_unit(_matrix(some.column("v"))))]
                rows = pa.array([p[0] for p in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([p[1] for p in pairs], pa.int32()), some.column("u").take(rows), some.column("v").take(rows)],
                                                 ["list", "u", "v"])

    return run


def _compare(keep: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            a, b = _matrix(left.column("v")), _matrix(right.column("v"))
            ids, own = right.column("u").to_numpy(), left.column("u").to_numpy()
            order = np.argsort(ids, kind="stable")
            b, ids = b[order], ids[order]
            norms = np.linalg.norm(b, axis=1)
            for start in range(0, len(a), 500):
                x = a[start:start + 500]
                scores = (x @ b.T) / (np.linalg.norm(x, axis=1)[:, None] * norms)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
                q.append(np.repeat(own[start:start + 500], top.shape[1]))
                c.append(ids[top].ravel())
                s.append(np.take_along_axis(scores, top, axis=1).ravel())
        return pa.table({"q": np.concatenate(q), "c": np.concatenate(c), "score": np.concatenate(s)})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, sample_rows: int = SAMPLE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` found for each row of ``queries``.

    Nearest is the largest cosine on the original vectors in double precision, ties to the smaller vec_id; a row with
    the query's own id is no candidate. Equal vectors are one entry, so a vector that many rows repeat costs one
    comparison; of its rows the ``k`` + 1 least ids are all that an answer can hold. Vectors that are null, zero, or hold
    null or non-finite components take no part, nor those of another length than the commonest, nor rows without id; a
    query without candidates has no rows; empty tables give an empty one; other columns are ignored. The lists are fitted
    on ``sample_rows`` vectors at most, taken by hash; every vector is indexed.
    """
    spark = vectors.sparkSession
    rows = _valid(pick(vectors, id=vec_id, v=vector)).distinct()
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = f"query_id bigint, rank int, `{vec_id}` bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = cut_lineage(rows.where(F.size("v") == sizes.n).select(F.col("id").cast("bigint").alias("id"), "v"))
    place = Window.partitionBy("v").orderBy("id")
    entries = cut_lineage(
        rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("u"), "v", "ids")
    )
    asked = _valid(pick(queries, id=vec_id, v=vector)).where(F.size("v") == sizes.n).select(F.col("id").cast("bigint").alias("id"), "v").distinct()
    asked = cut_lineage(asked.select("id", F.xxhash64("v").alias("h"), "v"))
    kinds = asked.groupBy("v").agg(F.min("id").alias("u"))
    kinds = cut_lineage(kinds)
    asked = asked.join(kinds, "v").select("id", "u")
    count = entries.count()
    sample = entries.orderBy(F.xxhash64("u"), "u").limit(sample_rows).select("v").toArrow()
    index = spark.sparkContext.broadcast(build(_unit(_matrix(sample.column("v"))), max(1, min(MOST_LISTS, math.ceil(count / CELL), math.ceil(sample.num_rows / 8)))))
    kind = "list int, u bigint, v array<double>"
    posts = cut_lineage(entries.select("u", "v").mapInArrow(_spread(index, "homes"), kind))
    routes = cut_lineage(kinds.select("u", "v").mapInArrow(_spread(index, "routes"), kind))
    # Both tables have a row per list, of which there are MOST_LISTS at most.
    parts = posts.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    chunks = routes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
    cells = F.broadcast(parts.join(chunks, "list"))
    number = F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")
    right = posts.join(cells, "list").select("list", number.alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "u", "v")
    number = F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int")
    left = routes.join(cells, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), number.alias("chunk"), "u", "v")
    keys = ["list", "part", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(k + 1), "q bigint, c bigint, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    top = found.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    members = top.join(entries.select(F.col("u").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("found"))
    answers = asked.join(members, asked["u"] == members["q"]).where("id <> found")
    rank = Window.partitionBy("id").orderBy(F.desc("score"), "found")
    return answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(
        F.col("id").alias("query_id"), "rank", F.col("found").alias(vec_id), "score")
