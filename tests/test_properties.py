"""Random worlds: the waves equal the sequential greedy, and every plan is safe at every prefix."""

import random

import pytest
from pyspark.sql import functions as F

from stowline.plans import checks
from stowline.operators.policy import collapse_to_blob, desired_placement, goal_locations
from stowline.plans.build import build_plan
from stowline.plans.placement import can_evict, choose_source, classify_ops, need_place
from stowline.plans.sequence import admit_largest, sequence
from stowline.scale import order_buckets
from tests.plain_plan import plain_sequence
from tests.worlds import GIB, Worlds

ROWS = "library_id long, blob_id long, dest string, size long, ok boolean, room long"


def random_rows(seed: int):
    rnd = random.Random(seed)
    rows, room = [], {}
    for blob in range(400):
        lib = 0 if rnd.random() < 0.4 else rnd.randrange(1, 12)
        dest = rnd.choice("ab")
        size = rnd.choice([0, 64, rnd.randrange(1, 2000), rnd.randrange(1, 60)])
        limit = room.setdefault((lib, dest), rnd.choice([-5, 0, 300, 2000, 9000]))
        rows.append((lib, blob, dest, size, rnd.random() < 0.9, limit))
    return rows


def greedy(rows):
    left, taken = {}, set()
    for lib, blob, dest, size, ok, room in sorted(rows, key=lambda r: (r[0], r[2], -r[3], r[1])):
        free = left.setdefault((lib, dest), room)
        if ok and size <= free:
            left[(lib, dest)] = free - size
            taken.add((lib, blob, dest))
    return taken


@pytest.mark.parametrize("seed,rows_per_bucket", [(1, 10_000), (2, 10_000), (3, 15), (4, 60)])
def test_waves_equal_the_sequential_greedy(spark, seed, rows_per_bucket):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    df, buckets = order_buckets(df, ["library_id", "dest"], "size", "blob_id", descending=True, rows_per_bucket=rows_per_bucket)
    assert bool(buckets) == (rows_per_bucket < 10_000)
    got = admit_largest(df, buckets, "ok", "room").filter("admitted").select("library_id", "blob_id", "dest")
    assert {tuple(r) for r in got.collect()} == greedy(rows)


def random_worlds(seed: int, count: int) -> Worlds:
    rnd = random.Random(seed)
    w = Worlds()
    for lib in range(count):
        volumes, clouds = ["d", "e", "x"], ["gdrive", "onedrive"]
        for name in volumes:
            w.place(lib, name, rnd.randrange(1 << 21, 12 * GIB), online=rnd.random() < 0.9, final=rnd.random() < 0.8,
                    shuttle=rnd.random() < 0.4, overlay=rnd.random() < 0.1)
        for name in clouds:
            w.place(lib, name, rnd.randrange(1 << 21, 30 * GIB))
        for n, keep in enumerate(("cloud_only", "prefer", "required", "prefer")):
            w.policy(lib, f"c{n}", keep, rnd.randrange(1, 4), rnd.choice(["most_free", "any", "specific"]), rnd.sample(clouds, rnd.randrange(1, 3)),
                     rnd.sample(volumes, rnd.randrange(0, 3)), pin=rnd.random() < 0.2, subdir=rnd.choice([None, "In", "Out/x"]), order=n)
        online = {loc: on for l, loc, _, _, on, *_ in w.locations if l == lib}
        for blob in range(rnd.randrange(1, 14)):
            size = None if rnd.random() < 0.03 else rnd.choice([0, rnd.randrange(1 << 21, 5 * GIB), 1 << 30])
            group = f"c{rnd.randrange(4)}"
            for loc in rnd.sample(volumes + clouds, rnd.randrange(1, 4)):
                hollow = loc in volumes and rnd.random() < 0.15
                row = (lib, blob, len(w.replicas) + 1, loc, "volume" if loc in volumes else "cloud", size, rnd.choice(["verified", "verified", "suspect"]),
                       "placeholder" if hollow else ("local_full" if loc in volumes else "cloud_native"), online[loc],
                       f"/dir/{rnd.choice(['f', 'g'])}{blob if rnd.random() < 0.9 else 0}.mp4", group)
                w.replicas.append(row)
    return w


@pytest.mark.parametrize("seed,rows_per_bucket", [(11, 1_000_000), (12, 7)])
def test_random_plans_are_safe(spark, seed, rows_per_bucket):
    replicas, policies, members, locations = random_worlds(seed, 60).frames(spark)
    plan = build_plan(replicas, policies, members, locations, reserve=GIB // 2, rows_per_bucket=rows_per_bucket)
    assert plan.ops.count() > 50 and plan.ops.filter("kind = 'evict'").count() > 3
    takers = plan.ops.filter("kind IN ('download', 'shuttle')").select("library_id", "plan_id", "seq")
    breaches = checks.check_space(plan.ops, locations, GIB // 2).join(takers, ["library_id", "plan_id", "seq"], "left_semi")
    assert breaches.collect() == []
    assert checks.check_last_copy(plan.ops, replicas).collect() == []
    assert checks.check_prefix(plan.residuals, checks.space_ledger(plan.ops, locations)).collect() == []
    assert checks.check_no_overwrite(plan.ops, replicas).collect() == []
    assert checks.check_placeholder(plan.ops, replicas).collect() == []
    assert checks.cloud_delete_audit(plan.ops, locations).collect() == []
    overdrawn = plan.residuals.filter("location_kind = 'cloud' AND residual_after < 0")
    assert overdrawn.collect() == []
    # A satisfiable plan reaches every goal but the preferred ones it gave up.
    good = plan.summary.filter("status = 'drafted'").select("library_id")
    missed = checks.check_goal(plan.goals.filter("size IS NOT NULL"), plan.dropped, replicas, plan.ops)
    noop = plan.needs.filter("verdict = 'noop' OR no_source").select("library_id", "blob_id", "dest")
    assert missed.join(good, "library_id", "left_semi").join(noop, ["library_id", "blob_id", "dest"], "left_anti").collect() == []
    # No operation reads a file that an earlier one evicted, and no file is evicted twice.
    evicted = plan.ops.filter("kind = 'evict'").select("library_id", "file_id", F.col("seq").alias("gone_at"))
    assert plan.ops.filter("kind <> 'evict'").join(evicted, ["library_id", "file_id"]).filter("seq > gone_at").collect() == []
    assert evicted.groupBy("library_id", "file_id").count().filter("count > 1").collect() == []


@pytest.mark.parametrize("seed,rows_per_bucket", [(21, 1_000_000), (22, 5)])
def test_sequence_equals_one_operation_at_a_time(spark, seed, rows_per_bucket):
    replicas, policies, members, locations = random_worlds(seed, 40).frames(spark)
    blobs = collapse_to_blob(desired_placement(replicas.select("library_id", "blob_id", "size", "collection"), policies))
    goals = goal_locations(blobs, replicas, policies, members, locations)
    needs = choose_source(need_place(goals, replicas), replicas)
    evicts = can_evict(goals, replicas, needs, blobs)
    classed = classify_ops(needs, evicts)
    done = sequence(classed, evicts, replicas, locations, GIB // 2, rows_per_bucket)
    rows = [[r.asDict() for r in df.collect()] for df in (classed, evicts, replicas, locations)]
    want = plain_sequence(*rows, GIB // 2)
    got = {}
    for r in done.ops.orderBy("library_id", "seq").collect():
        got.setdefault(r["library_id"], []).append((r["kind"], r["blob_id"], r["file_id"], r["src"], r["dest"], r["staging"]))
    assert got == want and sum(map(len, want.values())) > 40
    left = {(r["library_id"], r["location_id"]): r["free_bytes"] for r in done.balance.collect()}
    start = {(r["library_id"], r["location_id"]): r["free_bytes"] for r in rows[3]}
    size = {(r["library_id"], r["blob_id"]): r["size"] for r in rows[2]}
    for lib, ops in want.items():
        for kind, blob, _, src, dest, _ in ops:
            start[lib, src if kind == "evict" else dest] += size[lib, blob] if kind == "evict" else -size[lib, blob]
    assert left == start
