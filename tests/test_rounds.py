"""What is read or derived once only: plans that don't repeat their input, and groups that are hashed."""

from datetime import datetime

from pyspark.sql import functions as F

from stowline.operators import inventory, observability, policy
from stowline.workload import load_all, plan_queries
from stowline.workload.registry import QUERIES, Tables
from stowline.workload.views import VIEWS


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_replicas_are_hashed_and_the_same(spark, tmp_path, capsys):
    items = [(1, 1, "R", "F"), (1, 1, "A", "O"), (5, 1, "S", "A"), (5, 1, "R", "F"), (5, 2, None, None), (5, 4, "R", None), (10, 1, None, "F"),
             (10, 1, "R", "Z"), (15, 2, "N", "E"), (None, 1, "R", "F"), (5, None, "R", "F")]
    spark.createDataFrame([(*row, datetime(2024, 1, 1)) for row in items], "l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 3, "SMALL") for k in (1, 5, 10, 10, 15)] + [(5, None, None)], "p_partkey long, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    t = Tables(spark, str(tmp_path))
    got, want = t("v_replicas"), t.sql(VIEWS["v_replicas"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 6
    assert "SortAggregate" not in plan_of(got, capsys)


def test_snapshots_meet_once(spark, capsys):
    schema = "library_id long, location_id long, path string, size long, mtime_utc long, ntfs_file_id string, volume_serial string"
    prev = spark.createDataFrame([(0, 1, "/a", 1, 1, "n", "s"), (0, 1, "/b", 1, 1, None, None), (0, 1, None, 1, 1, None, None)], schema)
    curr = spark.createDataFrame([(0, 1, "/c", 2, 1, "n", "s"), (0, 1, "/b", 1, 2, None, None)], schema)
    found = inventory.diff_snapshots(prev, curr)
    assert {(r.path, r.old_path, r.change, r.body_changed) for r in found.collect()} == {
        ("/c", "/a", "renamed", True), ("/b", None, "changed", True), (None, None, "missing", False)}
    assert "Join" not in plan_of(found, capsys)


def test_needs_and_texts_are_derived_once(spark, capsys):
    needs = spark.createDataFrame([(0, [1, 2])], "library_id long, b array<long>").select(
        "library_id", F.explode("b").alias("blob_id"), F.lit(9).cast("long").alias("dest"), F.lit("/x").alias("dest_path"))
    files = spark.createDataFrame([(0, 9, "/y", 1)], "library_id long, location_id long, path string, blob_id long")
    judged = policy.dest_conflicts(needs, files)
    assert {r.verdict for r in judged.collect()} == {"needs_manual"} and "Generate" not in plan_of(judged, capsys)
    logs = spark.createDataFrame([(1, "INFO", "at /y now", {"f": "D:/y"})], "log_id long, level string, msg string, fields map<string,string>")
    known = spark.createDataFrame([("/y",), ("/yet/other.mp4",)], "path string")
    leaks = observability.path_leak_audit(logs.union(logs.withColumn("msg", F.lit("/yet/other.mp4")).withColumn("log_id", F.lit(2))), known)
    assert {(r.log_id, r.field, r.path) for r in leaks.collect()} == {(2, "msg", "/yet/other.mp4")}
    assert "Generate" not in plan_of(leaks, capsys)


def test_sources_are_chosen_without_storing_needs(spark, monkeypatch):
    stored, goals = [], spark.createDataFrame([(0, 1, 2, "volume", 10)], "library_id long, blob_id long, dest long, dest_kind string, size long")
    files = spark.createDataFrame([(7, 0, 1, 1, "/a", "local_full", "verified", True, "volume")], "file_id long, library_id long, blob_id long, "
                                  "location_id long, path string, hydration string, state string, is_online boolean, location_kind string")
    t = Tables(spark, "unused")
    t._made["v_files"], t.shared["goals"] = files, goals
    monkeypatch.setattr(plan_queries, "cut_lineage", lambda df: stored.append(df) or df)
    load_all()
    assert [tuple(r) for r in QUERIES["choose_source"](t).collect()] == [(0, 1, 2, 1, "volume", 7, False)]
    assert not stored
