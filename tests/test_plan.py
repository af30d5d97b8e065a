"""Golden plan and fixed scenarios, planned in one job."""

import json
from datetime import timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stowline.operators.capacity import with_usable
from stowline.operators.journal import reverse_plan, space_drift, undo_refusals
from stowline.operators.policy import prefer_fallback
from stowline.plans import checks
from stowline.plans.build import build_plan, plan_name, plan_shortfall, stored_ops, stored_plans
from stowline.plans.placement import too_large
from stowline.plans.shortfall import shortfall_steps
from stowline.plans.simulate import plan_show
from tests.worlds import GIB, Worlds, gib, golden


def scenarios() -> Worlds:
    w = Worlds()
    golden(w, 0)
    both = ["gdrive", "onedrive"]
    # 1: a download must not starve a shuttle. 2: one shuttle.
    for lib, download in ((1, True), (2, False)):
        w.place(lib, "local-d", 4.0)
        w.place(lib, "gdrive", 50.0)
        w.place(lib, "onedrive", 50.0)
        w.policy(lib, "stay", "prefer", 2, "any", both, ["local-d"])
        w.policy(lib, "move", "cloud_only", 1, "specific", ["onedrive"], order=1)
        if download:
            w.file(lib, 1, 2.5, "gdrive", "/a.mp4", collection="stay")
        w.file(lib, 2, 2.0 if download else 2.4, "gdrive", "/b.mp4", collection="move")
    # 3, 4: a body too large for the internal disk hops over an external one, which is missing in 4.
    for lib, online in ((3, True), (4, False)):
        w.place(lib, "local-d", 4.0)
        w.place(lib, "ext", 2048.0, online=online, shuttle=True, final=False)
        w.place(lib, "gdrive", 50.0)
        w.place(lib, "onedrive", 50.0)
        w.policy(lib, "move", "cloud_only", 1, "specific", ["onedrive"])
        w.file(lib, 1, 8.0, "gdrive", "/x.mp4", collection="move")
    golden(w, 5, extra_required=True)
    # 6: required footprint beyond any room. 7: copy to an external final volume that is too small.
    for lib, target in ((6, "local-d"), (7, "ext")):
        w.place(lib, "local-d", 4.0)
        w.place(lib, "ext", 2.0, final=True)
        w.place(lib, "gdrive", 50.0)
        w.policy(lib, "must", "required", 2, "any", ["gdrive"], [target])
        w.file(lib, 1, 90.0 if lib == 6 else 1.5, "gdrive" if lib == 6 else "local-d", "/x.mp4", collection="must")
    # 8: a preferred copy does not fit and is given up.
    w.place(8, "local-d", 4.0)
    w.place(8, "gdrive", 50.0)
    w.policy(8, "stay", "prefer", 2, "any", ["gdrive"], ["local-d"])
    w.file(8, 1, 5.0, "gdrive", "/x.mp4", collection="stay")
    # 9: another file sits at the dest path.
    w.place(9, "local-d", 40.0)
    w.place(9, "gdrive", 50.0)
    w.policy(9, "move", "cloud_only", 1, "specific", ["gdrive"], subdir="In")
    w.file(9, 1, 1.0, "local-d", "D:\\a\\x.mp4", collection="move")
    w.file(9, 2, 1.0, "gdrive", "in/X.mp4", collection="move")
    # 10: a placeholder is no source and no copy; an unplugged disk counts for nothing.
    w.place(10, "local-d", 40.0)
    w.place(10, "ext", 40.0, online=False)
    w.place(10, "gdrive", 50.0)
    w.policy(10, "move", "cloud_only", 1, "specific", ["gdrive"])
    w.file(10, 1, 1.0, "local-d", "/p.mp4", "verified", "move", hydration="placeholder")
    w.file(10, 2, 1.0, "ext", "/q.mp4", "verified", "move", online=False)
    w.file(10, 3, None, "local-d", "/unknown-size.mp4", "verified", "move")
    # 11: two local copies outside the goal, each the other's only company, while the cloud is full.
    w.place(11, "local-d", 4.0)
    w.place(11, "local-e", 4.0)
    w.place(11, "gdrive", 0.5)
    w.policy(11, "move", "cloud_only", 1, "specific", ["gdrive"])
    w.file(11, 1, 1.0, "local-d", "/t.mp4", collection="move")
    w.file(11, 1, 1.0, "local-e", "/t.mp4", collection="move")
    return w


@pytest.fixture(scope="module")
def world(spark):
    return scenarios().frames(spark)


@pytest.fixture(scope="module")
def plan(world):
    return build_plan(*world, reserve=GIB)


@pytest.fixture(scope="module")
def ops(plan):
    rows = {}
    for r in plan.ops.orderBy("library_id", "seq").collect():
        rows.setdefault(r["library_id"], []).append(r)
    return rows


@pytest.fixture(scope="module")
def status(plan):
    return {r["library_id"]: r for r in plan.summary.collect()}


def residual(plan, lib, location):
    rows = plan.residuals.filter((F.col("library_id") == lib) & (F.col("location_id") == location)).orderBy("seq").collect()
    return [(round(r["residual_during"] / GIB, 2), round(r["residual_after"] / GIB, 2)) for r in rows]


def test_golden_plan(plan, ops, status):
    got = [(r["kind"], r["blob_id"], r["dest"]) for r in ops[0]]
    assert got == [("upload_evict", 2, "gdrive"), ("evict", 2, None), ("upload_keep", 1, "onedrive"), ("upload_keep", 3, "onedrive"),
                   ("download", 4, "local-d"), ("download", 6, "local-d"), ("download", 5, "local-d")]
    assert [r["seq"] for r in ops[0]] == list(range(1, 8))
    assert [r["dest_path"] for r in ops[0]][:3:2] == ["Archives/old.mp4", "Gaming/Clips/boss.mp4"]
    assert [after for _, after in residual(plan, 0, "local-d")] == [4.0, 7.5, 7.5, 7.5, 5.3, 3.3, 1.5]
    s = status[0]
    assert (s["status"], s["ops"], round(s["min_residual"] / GIB, 2), round(s["moved_bytes"] / GIB, 2)) == ("drafted", 7, 1.5, 15.8)
    assert all(r["blob_id"] != 7 for r in ops[0])


def test_shuttle_runs_before_download(plan, ops):
    assert [(r["kind"], r["blob_id"]) for r in ops[1]] == [("shuttle", 2), ("download", 1)]
    assert residual(plan, 1, "local-d") == [(2.0, 4.0), (1.5, 1.5)]


def test_shuttle_trough(plan, ops, status):
    assert residual(plan, 2, "local-d") == [(1.6, 4.0)]
    assert round(status[2]["min_residual"] / GIB, 2) == 1.6


def test_external_hop(ops, status):
    assert [(r["kind"], r["staging"]) for r in ops[3]] == [("shuttle", "ext")]
    assert 4 not in ops and status[4]["status"] == "unsatisfiable"


def test_unsatisfiable(plan, status):
    assert [status[n]["status"] for n in (5, 6, 7)] == ["unsatisfiable"] * 3
    reasons = {(r["library_id"], r["reason"]) for r in plan.problems.collect()}
    assert {(5, "leftover"), (6, "leftover"), (7, "leftover")} <= reasons


def test_preferred_copy_is_given_up(plan, ops, status):
    assert 8 not in ops and 8 not in status
    assert [(r["blob_id"], r["dest"]) for r in plan.dropped.filter("library_id = 8").collect()] == [(1, "local-d")]
    kept = plan.goals.filter("library_id = 8")
    row = prefer_fallback(kept, kept.filter("dest_kind = 'cloud'")).first()
    assert (row["wanted"], row["placed"], row["effective_min"], row["local_preferred_unmet"], row["replica_shortfall"]) == (2, 1, 1, True, True)


def test_conflict_needs_a_person(ops, status):
    assert 9 not in ops and status[9]["status"] == "needs_manual"


def test_placeholder_offline_and_unknown_size(plan, ops, status):
    assert 10 not in ops and status[10]["status"] == "unsatisfiable"
    # The blob that is nowhere but in a placeholder is no part of the plan; the unplugged disk is named.
    assert {r["reason"] for r in plan.problems.filter("library_id = 10").collect()} == {"volume_offline"}
    assert [(r["role"], r["location_id"], r["blobs"]) for r in plan.offline.filter("library_id = 10").collect()] == [("src", "ext", 1)]
    assert plan.goals.filter("library_id = 10 AND blob_id = 1").isEmpty()


def test_two_evicts_never_count_on_each_other(ops):
    assert [(r["kind"], r["blob_id"]) for r in ops[11]] == [("evict", 1)]


def test_checks_find_nothing(plan, world):
    replicas, _, _, locations = world
    assert checks.check_space(plan.ops, locations, GIB).isEmpty()
    assert checks.check_last_copy(plan.ops, replicas).isEmpty()
    assert checks.check_prefix(plan.residuals, checks.space_ledger(plan.ops, locations)).isEmpty()
    assert checks.check_no_overwrite(plan.ops, replicas).isEmpty()
    assert checks.check_placeholder(plan.ops, replicas).isEmpty()
    assert checks.cloud_delete_audit(plan.ops, locations).isEmpty()
    met = plan.goals.filter("library_id IN (0, 1, 2, 3)")
    assert checks.check_goal(met, plan.dropped, replicas, plan.ops).isEmpty()


def test_small_buckets_give_the_same_plan(plan, world):
    split = build_plan(*world, reserve=GIB, rows_per_bucket=2)
    key = ["library_id", "seq", "kind", "blob_id", "file_id", "src", "dest", "staging"]
    assert sorted(map(str, split.ops.select(*key).collect())) == sorted(map(str, plan.ops.select(*key).collect()))
    same = ["library_id", "seq", "location_id", "residual_during", "residual_after"]
    assert sorted(map(str, split.residuals.select(*same).collect())) == sorted(map(str, plan.residuals.select(*same).collect()))


def test_stored_form(plan):
    rows = stored_ops(plan).filter("library_id = 1").orderBy("seq").collect()
    assert rows[0]["residual_during"] == {"local-d": gib(2.0), "onedrive": gib(48.0)}
    assert rows[0]["residual_after"]["local-d"] == gib(4.0) and rows[0]["rollback_note"]


def test_listing(plan):
    rows = plan_show(plan.ops.filter("library_id = 0"), plan.residuals).collect()
    assert [r["after_text"] for r in rows] == ["4.00 GiB", "7.50 GiB", "7.50 GiB", "7.50 GiB", "5.30 GiB", "3.30 GiB", "1.50 GiB"]


def test_too_large_by_itself(plan, world):
    locations = world[3]
    none = plan.ops.filter("kind = 'evict'").select("library_id", F.col("src").alias("location_id"), "size")
    got = too_large(plan.needs, none, with_usable(locations, GIB).drop("usable"), GIB).select("library_id", "blob_id").collect()
    assert {(r[0], r[1]) for r in got} >= {(6, 1), (8, 1)}


def test_unsat_report(plan, world):
    left = plan.leftover.withColumn("no_source", F.lit(False))
    got = {r["library_id"]: r for r in checks.unsat_report(left, with_usable(world[3], GIB)).collect()}
    assert got[6]["reason"] == "volume_full" and got[6]["min_shortfall"] == gib(87.0)
    assert got[4]["reason"] == "staging_full"


def test_drift_gates(plan, spark):
    def live(free):
        return spark.createDataFrame([(0, "local-d", gib(free))], "library_id long, location_id string, live_free long")

    slack = 64 << 20
    first = space_drift(plan.residuals.filter("library_id = 0 AND seq = 5"), live(6.0), slack, GIB).collect()
    assert [r["reason"] for r in first] == ["start_free_below_sim"]
    assert space_drift(plan.residuals.filter("library_id = 0 AND seq = 5"), live(7.5), slack, GIB).isEmpty()
    last = plan.residuals.filter("library_id = 0 AND seq = 7").withColumn("residual_before", F.lit(gib(2.5)))
    assert [r["reason"] for r in space_drift(last, live(2.5), slack, GIB).collect()] == ["trough_would_breach_reserve"]


def test_undo_refuses_to_breach_the_reserve(plan, world, spark):
    ops = plan.ops.filter("library_id = 0").withColumn("op_id", F.col("seq").cast("string"))
    journal = ops.select("op_id", F.lit("Committed").alias("state"), F.lit(True).alias("we_created"))
    back = reverse_plan(ops, journal)
    kinds = [r["undo_kind"] for r in back.orderBy("undo_seq").collect()]
    assert kinds == ["delete"] * 5 + ["download", "delete"]
    after = spark.createDataFrame([(0, "local-d", "volume", gib(1.5)), (0, "gdrive", "cloud", gib(11.5)), (0, "onedrive", "cloud", gib(33.7))],
                                  "library_id long, location_id string, kind string, free_bytes long")
    final = world[0].filter("library_id = 0")
    reasons = {r["reason"] for r in undo_refusals(back, final, after, gib(5.0)).collect()}
    assert "reserve_breach" in reasons


def test_offline_targets_and_staging_are_named(plan):
    found = {(r["library_id"], r["role"], r["location_id"]) for r in plan.offline.collect()}
    assert found == {(4, "staging", "ext"), (10, "src", "ext")}


def test_warnings_and_plan_rows(plan, status):
    warned = {(r["library_id"], r["blob_id"], r["warning"], r["wanted"], r["placed"], r["reason"]) for r in plan.warnings.collect()}
    assert {w for w in warned if w[0] == 8} == {(8, 1, "local_preferred_unmet", 2, 1, "prefer_dropped_local"), (8, 1, "replica_shortfall", 2, 1, "prefer_dropped_local")}
    assert not [w for w in warned if w[0] in (1, 2, 3)]
    rows = {r["library_id"]: r for r in stored_plans(plan).collect()}
    assert set(rows) == set(status) and rows[0]["status"] == "drafted" and rows[0]["staging_reserve"] == GIB
    summary = json.loads(rows[0]["summary"])
    assert summary["ops"] == 7 and summary["moved_bytes"] == rows_of(plan, 0) and rows[0]["min_residual"] == status[0]["min_residual"]
    assert json.loads(rows[10]["summary"])["problems"] == {"volume_offline": 1}


def rows_of(plan, lib):
    return plan.ops.filter((F.col("library_id") == lib) & (F.col("kind") != "evict")).agg(F.sum("size")).first()[0]


def test_two_plans_of_a_library_are_apart(plan, world):
    later = plan_name(plan.created_at + timedelta(microseconds=1))
    again = plan_name(plan.created_at.astimezone(timezone(timedelta(hours=5))))
    row = plan.ops.filter("library_id = 0").select("plan_id", later.alias("later"), again.alias("again")).first()
    assert row["plan_id"] == row["again"] != row["later"] and len(row["plan_id"]) == len("file-plan-") + 8


def test_shortfalls(plan):
    got = {(r["library_id"], r["dest"]): r for r in plan_shortfall(plan).collect()}
    six = got[6, "local-d"]
    assert (six["cause"], six["least_for_one"], six["least_for_all"]) == ("volume_full", gib(87.0), gib(87.0)) and "lower_reserve" not in six["suggestions"]
    seven = got[7, "ext"]
    assert seven["least_for_one"] == gib(0.5) and seven["suggestions"][:2] == ["mark_cloud_only", "lower_reserve"]
    four = got[4, "onedrive"]
    assert (four["cause"], four["least_for_one"]) == ("staging_full", gib(5.0)) and "plug_in_shuttle_volume" in four["suggestions"]
    steps = shortfall_steps(plan.leftover.filter("library_id = 6"), plan.balance, rows_per_bucket=1).collect()
    assert [(r["nth"], r["extra_bytes"]) for r in steps] == [(1, gib(87.0))]


def test_running_shortfall_in_buckets(spark):
    left = spark.createDataFrame([(0, b, "d", "volume", s, "download") for b, s in ((1, 50), (2, 10), (3, 30), (4, 10))],
                                 "library_id long, blob_id long, dest string, dest_kind string, size long, op_class string")
    balance = spark.createDataFrame([(0, "d", "volume", 25, 25, True, False, False)],
                                    "library_id long, location_id string, kind string, free_bytes long, usable long, is_online boolean, is_shuttle boolean, is_overlay boolean")
    for per_bucket in (1_000_000, 1):
        rows = sorted(tuple(r) for r in shortfall_steps(left, balance, per_bucket).select("nth", "blob_id", "extra_bytes").collect())
        assert rows == [(1, 2, 0), (2, 4, 0), (3, 3, 25), (4, 1, 75)]


def test_a_collision_stops_its_library_only(spark, world):
    replicas = world[0].filter("library_id IN (1, 2)").withColumn("kind", F.lit("byte"))
    twice = replicas.filter("library_id = 2").limit(1).withColumns({"blob_id": F.lit(99).cast("long"), "file_id": F.lit(999).cast("long"), "size": F.lit(7).cast("long"), "path": F.lit("/other.mp4")})
    odd = replicas.filter("library_id = 1").limit(1).withColumns({"blob_id": F.lit(98).cast("long"), "file_id": F.lit(998).cast("long"), "kind": F.lit("directory")})
    mixed = replicas.unionByName(twice).unionByName(odd).withColumn("content_id", F.when(F.col("library_id") == 2, "sha256:same").otherwise(F.concat(F.lit("sha256:"), "blob_id")))
    plan = build_plan(mixed, *world[1:], reserve=GIB)
    status = {r["library_id"]: r["status"] for r in plan.summary.collect()}
    assert status == {1: "drafted", 2: "unsatisfiable"} and plan.ops.filter("library_id = 2").isEmpty()
    assert {r["reason"] for r in plan.problems.collect()} == {"content_id_collision"} and plan.needs.filter("blob_id = 98").isEmpty()


def test_hints_order_what_the_rules_allow(spark, world):
    w = Worlds()
    for lib in (0, 1):
        for name in ("local-d", "local-e", "local-f"):
            w.place(lib, name, 4.0, shuttle=name == "local-d")
        w.place(lib, "gdrive", 50.0)
        w.place(lib, "onedrive", 50.0)
        w.policy(lib, "Archives", "cloud_only", 1, "specific", ["gdrive"])
        w.policy(lib, "move", "cloud_only", 2, "specific", ["gdrive"], order=1)
        w.policy(lib, "hop", "cloud_only", 1, "specific", ["onedrive"], order=2)
        for loc in ("local-d", "local-e", "gdrive"):
            w.file(lib, 1, 2.0, loc, "/x.mp4", collection="move")
            w.file(lib, 2, 1.0, loc, "/y.mp4", collection="Archives")
        w.file(lib, 3, 1.0, "gdrive", "/z.mp4", collection="hop")
    rows = [(0, 7, 0, "FreeVolume", "local-e", None), (0, 7, 1, "EvictUnpinnedArchivesFirst", None, None), (0, 7, 2, "UseShuttle", "local-f", None)]
    asked = spark.createDataFrame(rows, "library_id long, intent_id long, ord int, kind string, location_id string, collection string")
    for per_bucket in (1_000_000, 1):
        plan = build_plan(*w.frames(spark), reserve=GIB, rows_per_bucket=per_bucket, priorities=asked)
        ops = {}
        for r in plan.ops.orderBy("library_id", "seq").collect():
            ops.setdefault(r["library_id"], []).append(r)
        gone = {lib: [(r["blob_id"], r["src"]) for r in some if r["kind"] == "evict"] for lib, some in ops.items()}
        # The named volume is freed first, and archives come first on each; without hints the largest go first.
        assert gone[0] == [(2, "local-e"), (1, "local-e"), (2, "local-d"), (1, "local-d")]
        assert gone[1] == [(1, "local-d"), (1, "local-e"), (2, "local-d"), (2, "local-e")]
        hops = {lib: [r["staging"] for r in some if r["kind"] == "shuttle"] for lib, some in ops.items()}
        assert hops == {0: ["local-f"], 1: ["local-d"]}
