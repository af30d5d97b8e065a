"""Operator 9: documents that hold a benchmark item. DataFrame functions only.

Windows have the size of an item in words and lie where the text shares a shingle with an item: the similarity asked
for is out of reach for all others. Each window and each item gets a 64-bit SimHash of its shingles, weighted by
their counts. The fingerprints are cut into ``RADIUS + 1`` blocks; two within the radius agree on one block at least, so
joining on blocks finds all of them. Exact weighted similarity over the shingles then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import WORD_SPLIT, checked_join, pick
from stowline.session import cut_lineage

BITS = 64
RADIUS = 22


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_SPLIT, -1), lambda w: w != "")


def _hashed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("w", F.transform(_words(F.col(text)), lambda w: F.xxhash64(w))).drop(text)


def _shingled(df: DataFrame, width: int) -> DataFrame:
    """Add s: the shingle at each place of the words w; the empty array where there are fewer than ``width``."""
    at = F.sequence(F.lit(0), F.size("w") - width)
    made = F.transform(at, lambda i: F.xxhash64(F.lit(width), *[F.get(F.col("w"), i + k) for k in range(width)]))
    return df.withColumn("s", F.when(F.size("w") >= width, made).otherwise(F.array().cast("array<bigint>")))


def _counted(shingles: Column) -> Column:
    """Each shingle with the number of its occurrence, so that sets of these are bags of those."""
    return F.transform(shingles, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(shingles, 1, i + 1), lambda y: y == x))))


def simhash(shingles: Column) -> Column:
    """Bit b is set if more shingles have it than not; a shingle that occurs twice counts twice."""
    def bit(b: Column) -> Column:
        votes = F.aggregate(shingles, F.lit(0), lambda acc, h: acc + F.getbit(h, b) * 2 - 1)
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b)))


def blocks(fingerprint: str) -> Column:
    """(number, bits) of each block; the blocks differ in width by one bit at most."""
    edges = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    parts = [F.struct(F.lit(i).alias("number"), F.shiftrightunsigned(F.col(fingerprint), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
             for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return F.array(*parts)


def leaks(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, text: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """(t, item_id, start, shared, total) of each text and item: the best window of the item's size in words, its place,
    and the weighted shingles shared and in either; 100 * shared >= percent * total. t is the xxhash64 of the text.

    Null and empty texts and items match nothing; an item of fewer words than ``size`` is one shingle; a text shorter
    than an item is its own window; repeated texts are looked at once; of equal windows the first counts; items
    without id match nothing. Texts are read whole.
    """
    own = pick(docs, x=text).where("x IS NOT NULL").withColumn("t", F.xxhash64("x"))
    bench = cut_lineage(_hashed(pick(items, item=item_id, x=item_text).where("item IS NOT NULL"), "x").where(F.size("w") > 0).withColumn("n", F.size("w")).dropDuplicates())
    widths = sorted({min(r.n, size) for r in bench.select(F.least("n", F.lit(size)).alias("n")).distinct().collect()})
    found = None
    for width in widths:
        some = bench.where(F.col("n") == width if width < size else F.col("n") >= size)
        one = _of_width(own, some, width, percent)
        found = one if found is None else found.unionByName(one)
    if found is None:
        kind = items.schema[item_id].dataType.simpleString()
        return own.sparkSession.createDataFrame([], f"t bigint, `{item_id}` {kind}, start int, shared int, total int")
    best = found.groupBy("t", "item").agg(F.max_by(F.struct("start", "shared", "total"), F.struct(F.col("shared") / F.col("total"), -F.col("start"))).alias("b"))
    return best.select("t", F.col("item").alias(item_id), "b.*")


def _of_width(own: DataFrame, bench: DataFrame, width: int, percent: int) -> DataFrame:
    entries = _shingled(bench, width).drop("w")
    index = entries.withColumn("fp", simhash(F.col("s"))).select("item", "n", "fp", _counted(F.col("s")).alias("bag"))
    parts = entries.select("n", F.posexplode_outer("s").alias("offset", "h")).where("h IS NOT NULL").distinct()
    offsets = cut_lineage(parts.groupBy("h").agg(F.collect_set(F.struct("n", "offset")).alias("at")))
    texts = _shingled(_hashed(own, "x"), width)
    # The outer form: for the inner one Catalyst adds a filter on the array's size, which inlines the words per shingle.
    places = texts.select("t", F.size("w").alias("words"), "s").select("t", "words", F.posexplode_outer("s").alias("p", "h")).where("h IS NOT NULL")
    hits = checked_join(places, offsets, ["h"], "inner").select("t", "words", "p", F.explode("at").alias("a"))
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("a.offset"), F.col("words") - F.col("a.n")))
    windows = cut_lineage(hits.select("t", F.col("a.n").alias("n"), start.alias("start")).distinct())
    grouped = windows.groupBy("t").agg(F.collect_list(F.struct("n", "start")).alias("found"))
    bodies = checked_join(own, windows.select("t").distinct(), ["t"], "left_semi").dropDuplicates(["t"])
    cut = (
        _shingled(_hashed(bodies, "x"), width).select("t", "s").join(grouped, "t")
        .select("t", "s", F.explode("found").alias("f"))
        .select("t", "f.n", "f.start", F.slice("s", F.col("f.start") + 1, F.greatest(F.lit(1), F.col("f.n") - (width - 1))).alias("s"))
    )
    printed = cut_lineage(cut.withColumn("fp", simhash(F.col("s"))))
    left = printed.select("t", "n", "start", "fp", F.explode(blocks("fp")).alias("k"))
    right = index.select("item", "n", F.col("fp").alias("other"), F.explode(blocks("fp")).alias("k"))
    near = (
        checked_join(left, cut_lineage(right.groupBy("n", "k").agg(F.collect_list(F.struct("item", "other")).alias("items"))), ["n", "k"], "inner")
        .select("t", "n", "start", "fp", F.explode("items").alias("m"))
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("m.other"))) <= RADIUS)
        .select("t", "n", "start", "m.item").distinct()
    )
    pairs = near.join(printed.select("t", "n", "start", "s"), ["t", "n", "start"]).join(index.select("item", "n", "bag"), ["item", "n"])
    shared = F.size(F.array_intersect("own", "bag"))
    return (
        pairs.withColumn("own", _counted(F.col("s"))).withColumn("shared", shared)
        .withColumn("total", F.size("own") + F.size("bag") - F.col("shared"))
        .where(F.col("shared") * 100 >= F.col("total") * percent).select("t", "item", "start", "shared", "total")
    )


def decontaminate(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, whose text has no row in ``found`` (see :func:`leaks`)."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(F.col(text)).alias("t"), F.col(text).isNotNull().alias("has"))
    texts = cut_lineage(found.select("t").distinct())
    clean = checked_join(rows.where("has"), texts, ["t"], "left_anti").unionByName(rows.where("NOT has"))
    return clean.select("row.*")
