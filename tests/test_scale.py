"""The skew-safe building blocks give what the plain window or join gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stowline.scale import hot_keys, lookup_join, order_buckets, position_bucket, previous_in, rank_in, running_sum, skew_join


def skewed(spark, n=600, seed=7):
    """A third of the rows in one group, a third of them with one size."""
    rnd = random.Random(seed)
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 9), i, 4096 if rnd.random() < 0.34 else rnd.randrange(1 << 40)) for i in range(n)]
    return spark.createDataFrame(rows, "g long, id long, size long").repartition(5)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("rows_per_bucket", [5, 40, 10_000])
def test_running_sum_and_rank(spark, descending, rows_per_bucket):
    df = skewed(spark)
    order = [F.col("size").desc() if descending else F.col("size"), F.col("id")]
    bucketed, buckets = order_buckets(df, ["g"], "size", "id", descending, rows_per_bucket)
    assert bool(buckets) == (rows_per_bucket < 200)
    got = rank_in(running_sum(bucketed, ["g"], order, F.col("size"), "run", buckets), ["g"], order, "rank", buckets)
    w = Window.partitionBy("g").orderBy(*order)
    want = df.select("g", "id", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.row_number().over(w).cast("long").alias("rank"))
    assert sorted(got.select("g", "id", "run", "rank").collect()) == sorted(want.collect())


def test_no_bucket_of_a_hot_group_is_large(spark):
    bucketed, buckets = order_buckets(skewed(spark), ["g"], "size", "id", True, 20)
    assert buckets == ["_b1", "_b2"]
    assert bucketed.groupBy("g", *buckets).count().agg(F.max("count")).first()[0] <= 60


@pytest.mark.parametrize("rows_per_bucket", [5, 10_000])
def test_previous_row(spark, rows_per_bucket):
    df = skewed(spark)
    bucketed, buckets = order_buckets(df, ["g"], "size", "id", False, rows_per_bucket)
    order = [F.col("size"), F.col("id")]
    got = previous_in(bucketed, ["g"], order, F.struct("size", "id"), "id", "before", buckets)
    want = df.select("g", "id", F.lag("id").over(Window.partitionBy("g").orderBy(*order)).alias("before"))
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.select("g", "id", "before").collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("rows_per_bucket", [5, 10_000])
def test_null_order_tie_and_group(spark, descending, rows_per_bucket):
    rows = [(None if i % 3 == 0 else 1, i or None, None if i % 4 == 0 else i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, id long, size long").repartition(3)
    order = [F.col("size").desc() if descending else F.col("size"), F.col("id")]
    bucketed, buckets = order_buckets(df, ["g"], "size", "id", descending, rows_per_bucket)
    assert bool(buckets) == (rows_per_bucket == 5)
    got = rank_in(bucketed, ["g"], order, "rank", buckets).select("g", "id", "rank")
    want = df.select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long").alias("rank"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 60
    if not descending:
        before = previous_in(bucketed, ["g"], order, F.struct("size", "id"), "id", "before", buckets).select("g", "id", "before")
        lag = df.select("g", "id", F.lag("id").over(Window.partitionBy("g").orderBy(*order)).alias("before"))
        assert sorted(map(str, before.collect())) == sorted(map(str, lag.collect()))


def test_position_buckets(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "seq")
    assert [r[0] for r in df.orderBy("seq").select(position_bucket("seq", 4)).collect()] == [0] * 4 + [1] * 4 + [2] * 2


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [0, 1000])
def test_lookup_join_beyond_and_within_the_broadcast_bound(spark, how, limit):
    big = skewed(spark, 200)
    dim = spark.createDataFrame([(g, f"n{g}") for g in range(0, 6)], "g long, name string")
    got = lookup_join(big, dim, ["g"], how, broadcast_rows=limit)
    want = big.join(dim, ["g"], how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [20, 40, 10_000])
def test_skew_join(spark, how, hot_rows):
    big = skewed(spark, 240)
    small = spark.createDataFrame([(g, f"n{g}") for g in (0, 2, 5, 99)], "g long, name string")
    got = skew_join(big, small, ["g"], how, hot_rows=hot_rows)
    want = big.join(small, ["g"], how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_hot_keys_are_few_and_exact(spark):
    assert [r["g"] for r in hot_keys(skewed(spark, 240), ["g"], 40).collect()] == [0]
    assert hot_keys(skewed(spark, 240), ["g"], 1000) is None
