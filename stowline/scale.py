"""Building blocks that keep grouped work spread when one key holds a large share of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowline.session import cut_lineage

ROWS_PER_BUCKET = 1_000_000
BROADCAST_ROWS = 200_000


def lookup_join(big: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` to ``dim``, which holds at most one row per key.

    ``dim`` is broadcast only after its row count was checked; a larger one goes through :func:`skew_join`.
    Works for inner, left, left_semi and left_anti, all of which keep each ``big`` row whole.
    """
    on = list(on)
    if dim.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return big.join(F.broadcast(dim), on, how)
    return skew_join(big, dim, on, how)


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = ROWS_PER_BUCKET) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, stored; None when there are none.

    Beyond ``BROADCAST_ROWS`` of them the hottest are given, as :func:`skew_join` broadcasts them; it shuffles
    the rows of all others.
    """
    found = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    stored = cut_lineage(found.orderBy(F.desc("_n")).limit(BROADCAST_ROWS).select(*on))
    return None if stored.isEmpty() else stored


def skew_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", hot: DataFrame | None = None,
              hot_rows: int | None = ROWS_PER_BUCKET) -> DataFrame:
    """Join ``big`` to ``small``, which holds at most one row per key, without shuffling the rows of hot keys.

    Adaptive execution does not split a join side that an aggregate has just shuffled by the same key.
    Here the few hot keys of ``big`` are found first; their rows stay where they are and meet their
    ``small`` rows by broadcast, and only the rest is shuffled. ``hot_rows=None`` takes ``hot`` as given.
    """
    on = list(on)
    if hot is None and hot_rows is not None:
        hot = hot_keys(big, on, hot_rows)
    if hot is None:
        return big.join(small, on, how)
    few = F.broadcast(hot)
    cold = big.join(few, on, "left_anti").join(small, on, how)
    warm = big.join(few, on, "left_semi").join(F.broadcast(small.join(few, on, "left_semi")), on, how)
    return cold.unionByName(warm)


def order_buckets(df: DataFrame, group: Sequence[str], lead: str, ties: str | None = None,
                  descending: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET
                  ) -> tuple[DataFrame, list[str]]:
    """Add bucket columns that follow the order (lead, ties) and bound the rows of any (group, bucket).

    Small groups get no bucket at all. Otherwise the split points are approximate quantiles of the
    whole column: a bucket then holds about ``total / buckets`` rows over all groups together, so no
    group can exceed that in one bucket. A value of ``lead`` heavy enough to repeat among the split
    points becomes a bucket of its own and is split further by the quantiles of ``ties``. NULL has a bucket
    where a window's order puts it: first ascending, last descending.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(lead).isNull()).alias("empty"))
    biggest, total, empty = sizes.agg(F.max("n"), F.sum("n"), F.max("empty")).first()
    if not biggest or biggest <= rows_per_bucket:
        return df, []
    wanted = math.ceil(total / rows_per_bucket) + 1
    probs = [i / wanted for i in range(1, wanted)]
    columns = [lead] + ([ties] if ties else [])
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    points = dict(zip(columns, numbers.approxQuantile(columns, probs, 1 / (4 * wanted))))
    heavy = sorted({v for v in points[lead] if points[lead].count(v) > 1})
    splits = sorted(set(points[lead]) | {v + 1 for v in heavy})
    out = _bucketize(df, lead, splits, "_b1")
    if descending:
        out = out.withColumn("_b1", -F.col("_b1"))
    if not ties or not (heavy or empty > rows_per_bucket):
        return out, ["_b1"]
    out = _bucketize(out, ties, sorted(set(points[ties])), "_b2")
    is_heavy = F.col(lead).isNull() | F.col(lead).cast("double").isin(heavy)
    return out.withColumn("_b2", F.when(is_heavy, F.col("_b2")).otherwise(F.lit(0))), ["_b1", "_b2"]


def _bucketize(df: DataFrame, column: str, splits: list[float], out: str) -> DataFrame:
    source = f"_{out}_in"
    edges = [-math.inf, *splits, math.inf]
    model = Bucketizer(splits=edges, inputCol=source, outputCol=out, handleInvalid="keep")
    number = df.withColumn(source, F.col(column).cast("double"))
    numbered = F.when(F.col(source).isNull(), -1).otherwise(F.col(out).cast("int"))
    return model.transform(number).withColumn(out, numbered).drop(source)


def position_bucket(position: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Column:
    """Bucket of a dense 1-based position column; needs no pass over the data."""
    return F.floor((F.col(position) - 1) / F.lit(rows_per_bucket)).cast("long")


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, out: str,
                buckets: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sum of ``value`` per group.

    With ``buckets`` the window runs per (group, bucket) and is shifted by the totals of the earlier
    buckets: the only per-group window is over one row per bucket. NULL is a group of its own.
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not buckets:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(*upto)))
    keys = [*group, *buckets]
    earlier = Window.partitionBy(*group).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        df.groupBy(*keys).agg(F.sum(value).alias("_total"))
        .withColumn("_shift", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .drop("_total")
    )
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
    return _join_groups(df, shift, keys).withColumn(out, F.sum(value).over(local) + F.col("_shift")).drop("_shift")


def _join_groups(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join to one row per group, where NULL keys meet."""
    side = totals.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    meet = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return df.join(side, meet).drop(*[f"_of_{k}" for k in keys])


def rank_in(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str,
            buckets: Sequence[str] = ()) -> DataFrame:
    """1-based row number per group by a unique order, spread like :func:`running_sum`."""
    return running_sum(df, group, order, F.lit(1).cast("long"), out, buckets)


def previous_in(df: DataFrame, group: Sequence[str], order: Sequence[Column], last_by: Column, value: str,
                out: str, buckets: Sequence[str] = ()) -> DataFrame:
    """Value of the previous row per group; across a bucket edge it comes from the last filled bucket.

    ``last_by`` is the ascending order as one comparable column (a struct), used to find a bucket's last row.
    """
    if not buckets:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))
    keys = [*group, *buckets]
    carried = (
        df.groupBy(*keys).agg(F.max_by(value, last_by).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*group).orderBy(*buckets)))
        .drop("_last")
    )
    local = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(local) == 1
    joined = _join_groups(df, carried, keys)
    return joined.withColumn(out, F.when(first, F.col("_carry")).otherwise(F.lag(value).over(local))).drop("_carry")
