"""Streams continue where they stopped, and a replayed batch leaves one copy."""

import json

import pytest
from pyspark.sql import functions as F

from stowline.streaming import jobs
from stowline.streaming.tables import append_batches, read_batches

CHANGE = "library_id long, location_id string, item_key string, size long, change_no long, is_deleted boolean"


def write(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_inventory_continues_from_its_checkpoint(spark, tmp_path):
    source = str(tmp_path / "source")
    table, checkpoint = jobs.scratch(spark, "t")
    base = spark.createDataFrame([(0, "d", "keep", 1), (0, "d", "gone", 2), (0, "d", "old", 3)], "library_id long, location_id string, item_key string, size long")

    def run():
        changes = spark.readStream.schema(CHANGE).parquet(source)
        jobs.run_to_end(jobs.stream_inventory(changes, table, checkpoint))
        return {r["item_key"]: r["size"] for r in jobs.read_inventory(base, changes, table).collect()}

    write(spark, [(0, "d", "gone", None, 5, True), (0, "d", "old", 30, 6, False), (0, "d", "old", 31, 7, False), (0, "d", "new", 9, 8, False)], CHANGE, source)
    first = {"keep": 1, "old": 31, "new": 9}
    assert run() == first and run() == first
    write(spark, [(0, "d", "gone", 20, 10, False), (0, "d", "new", None, 9, True), (0, "d", "old", 1, 2, False)], CHANGE, source)
    assert run() == {"keep": 1, "old": 31, "gone": 20}
    changes = spark.readStream.schema(CHANGE).parquet(source)
    compacted = jobs.compact_inventory(base, changes, table, str(tmp_path / "snapshot"))
    assert {r["item_key"]: r["size"] for r in compacted.collect()} == {"keep": 1, "old": 31, "gone": 20}


def test_a_replayed_batch_is_stored_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, [(1,), (2,)], "v long", source)
    for attempt in range(2):
        stream = spark.readStream.schema("v long").parquet(source)
        jobs.run_to_end(append_batches(stream, folder, str(tmp_path / f"checkpoint{attempt}")))
    assert sorted(r["v"] for r in read_batches(spark, folder, "v long").collect()) == [1, 2]


def test_metrics_and_journal_take_the_newest_batch(spark, tmp_path):
    source = str(tmp_path / "metrics")
    schema = "name string, kind string, value long, ts timestamp"
    table, checkpoint = jobs.scratch(spark, "m")

    def run():
        jobs.run_to_end(jobs.stream_metrics(spark.readStream.schema(schema).parquet(source), table, checkpoint))
        return {r["name"]: r["value"] for r in jobs.read_metrics(spark, table).collect()}

    def rows(*values):
        return spark.createDataFrame([(*v[:3], v[3]) for v in values], "name string, kind string, value long, t string").select(
            "name", "kind", "value", F.col("t").cast("timestamp").alias("ts"))

    rows(("a", "counter", 2, "2024-01-01 00:00:00"), ("g", "gauge", 7, "2024-01-02 00:00:00")).write.parquet(source)
    assert run() == {"a": 2, "g": 7}
    rows(("a", "counter", 5, "2024-01-01 00:00:00"), ("g", "gauge", 1, "2024-01-01 00:00:00")).write.mode("append").parquet(source)
    assert run() == {"a": 7, "g": 7}


def test_nothing_unmasked_reaches_the_sink(spark, tmp_path):
    source = tmp_path / "logs"
    source.mkdir()
    lines = [json.dumps({"ts": "2024-01-01T00:00:00Z", "level": "INFO", "target": "t", "message": "Bearer SECRET1 sent", "token": "SECRET2",
                         "session_uri": "https://h/x?sig=SECRET3", "flag_secret": True, "size_token": 5.5}), "torn SECRET4 {"]
    (source / "a.jsonl").write_text("\n".join(lines))
    table, checkpoint = jobs.scratch(spark, "l")
    jobs.run_to_end(jobs.stream_redact(spark.readStream.text(str(source)), table, checkpoint))
    stored = spark.read.parquet(table).collect()
    assert len(stored) == 2 and "SECRET" not in str(stored)
    good = next(r for r in stored if r["corrupt_line"] is None)
    assert good["fields"]["flag_secret"] == "[REDACTED]" and good["fields"]["size_token"] == "[REDACTED]" and good["msg"] == "Bearer [REDACTED] sent"


def test_drift_readings(spark, tmp_path):
    source = str(tmp_path / "readings")
    write(spark, [(1, 0, "d", 600), (2, 0, "d", 750), (3, 0, "d", 400), (4, 0, "other", 0)], "id long, library_id long, location_id string, live_free long", source)
    waiting = spark.createDataFrame([(0, "d", "download", 220, 750)], "library_id long, location_id string, kind string, size long, residual_before long")
    readings = spark.readStream.schema("id long, library_id long, location_id string, live_free long").parquet(source)
    table, checkpoint = jobs.scratch(spark, "d")
    jobs.run_to_end(jobs.stream_drift(readings, waiting, table, checkpoint, slack=64, reserve=540))
    got = {r["id"]: r["reason"] for r in spark.read.parquet(table).collect()}
    assert got == {1: "start_free_below_sim", 2: "trough_would_breach_reserve", 3: "start_free_below_sim"}


def run_transitions(spark, arrivals, folder, checkpoint, source, grace_ms, lateness="10 minutes"):
    from stowline.streaming import transitions

    schema = "library_id long, op_id long, event_id long, state string, updated_at timestamp"
    for rows in arrivals:
        frame = spark.createDataFrame(rows, "library_id long, op_id long, event_id long, state string, minute long")
        frame.select("library_id", "op_id", "event_id", "state", F.timestamp_seconds(F.col("minute") * 60).alias("updated_at")).coalesce(1).write.mode("append").parquet(source)
        jobs.run_to_end(transitions.stream_transitions(spark.readStream.schema(schema).parquet(source), folder, checkpoint, lateness, grace_ms))
    return {(r.library_id, r.op_id, r.event_id, r.from_state, r.to_state) for r in read_batches(spark, folder, transitions.OUT).collect()}


def open_ops(spark, checkpoint):
    state = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return {tuple(r.key) for r in state.select("key").collect()}


def test_transitions_over_arrivals_with_late_rows_and_state_that_ends(spark, tmp_path):
    from stowline.operators.journal import transition_audit

    one = [(0, 1, 1, "ReservedSpace", 100), (1, 1, 2, "ReservedSpace", 100), (0, 2, 3, "Committed", 101), (0, 3, 4, "ReservedSpace", 102)]
    # Late by less than the lateness, and out of order: the Transferring of op 1 comes after its Verifying.
    two = [(0, 1, 6, "Verifying", 106), (1, 1, 7, "Committed", 106), (0, 1, 5, "Transferring", 103), (None, 9, 8, "Verifying", 106), (0, 9, 9, None, 106)]
    three = [(0, 1, 10, "NeedsAttention", 120), (0, 2, 11, "Transferring", 120), (0, 3, 12, "Transferring", 121), (0, 3, 13, "Transferring", 122)]
    beat = [[(-1, -1, -1, "NotStarted", 1000)], [(-1, -1, -2, "NotStarted", 1001)]]
    folder, checkpoint = jobs.scratch(spark, "tr")
    got = run_transitions(spark, [one, two, three, *beat], folder, checkpoint, str(tmp_path / "in"), 60 * 60_000)
    everything = spark.createDataFrame([(*r[:4], r[4] * 60) for r in one + two + three if r[0] is not None and r[3]],
                                       "library_id long, op_id long, event_id long, state string, updated_at long").withColumn("updated_at", F.timestamp_seconds("updated_at"))
    want = {tuple(r) for r in transition_audit(everything).collect()}
    assert got == want == {(0, 2, 3, "NotStarted", "Committed"), (1, 1, 7, "ReservedSpace", "Committed"), (0, 2, 11, "Committed", "Transferring")}
    # Ops 1 of both libraries ended an hour before the watermark and are gone; op 2 was reopened and op 3 never ended.
    assert open_ops(spark, checkpoint) == {(0, 2), (0, 3)}


def compaction_parts(spark, tmp_path, batches):
    source = str(tmp_path / "source")
    table, checkpoint = jobs.scratch(spark, "c")
    for rows in batches:
        write(spark, rows, CHANGE, source)
        jobs.run_to_end(jobs.stream_inventory(spark.readStream.schema(CHANGE).parquet(source), table, checkpoint))
    return table


BASE = "library_id long, location_id string, item_key string, size long"


def current(spark, table):
    from stowline.streaming import snapshots

    base = spark.createDataFrame([(0, "d", "keep", 1), (0, "d", "gone", 2)], BASE)
    return {r.item_key: r["size"] for r in snapshots.read_current(base, CHANGE, table).collect()}


def test_compaction_keeps_late_changes_and_replays_right(spark, tmp_path):
    from stowline.streaming import snapshots, storage

    table = compaction_parts(spark, tmp_path, [[(0, "d", "gone", None, 9, True), (0, "d", "a", 5, 7, False)], [(0, "d", "a", 6, 8, False)]])
    want = {"keep": 1, "a": 6}
    assert current(spark, table) == want
    first = snapshots.compact(spark, table, CHANGE)
    assert (first.version, first.high_water) == (1, 1) and current(spark, table) == want
    assert snapshots.compact(spark, table, CHANGE) == first
    # A change of a removed item and one of a newer item, both older than what the snapshot holds, lose.
    write(spark, [(0, "d", "gone", 3, 4, False), (0, "d", "a", 1, 2, False), (0, "d", "b", 9, 1, False)], CHANGE, f"{table}/batch_id=2")
    want["b"] = 9
    assert current(spark, table) == want
    # A replay of a folded batch writes its folder again; nobody reads it.
    write(spark, [(0, "d", "a", 99, 99, False)], CHANGE, f"{table}/batch_id=1")
    assert current(spark, table) == want
    second = snapshots.compact(spark, table, CHANGE)
    assert second.version == 2 and current(spark, table) == want
    assert snapshots.vacuum(spark, table) and set(storage.partitions(spark, table, "batch_id")) == {"2"}
    assert current(spark, table) == want and storage.exists(spark, first.snapshot)


def test_a_compaction_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    from stowline.streaming import snapshots, storage

    table = compaction_parts(spark, tmp_path, [[(0, "d", "a", 5, 7, False)], [(0, "d", "a", 6, 8, False)]])
    assert snapshots.versions(spark, table) == [snapshots.Version()]

    def crash(*_):
        raise RuntimeError("lost driver")

    publish = snapshots.publish
    monkeypatch.setattr(snapshots, "publish", crash)
    with pytest.raises(RuntimeError):
        snapshots.compact(spark, table, CHANGE)
    monkeypatch.setattr(snapshots, "publish", publish)
    assert snapshots.versions(spark, table) == [snapshots.Version()] and current(spark, table) == {"keep": 1, "gone": 2, "a": 6}
    orphans = storage.partitions(spark, f"{table}-snapshots", "v")
    made = snapshots.compact(spark, table, CHANGE)
    assert current(spark, table) == {"keep": 1, "gone": 2, "a": 6}
    assert set(snapshots.vacuum(spark, table)) == set(orphans.values()) and storage.exists(spark, made.snapshot)
    # An unfinished batch, without the mark of a finished job, is not folded.
    write(spark, [(0, "d", "a", 7, 9, False)], CHANGE, f"{table}/batch_id=2")
    storage.remove(spark, f"{table}/batch_id=2/_SUCCESS")
    assert snapshots.compact(spark, table, CHANGE) == made and current(spark, table)["a"] == 7


def test_expired_days_leave_the_disk_and_kept_files_stay(spark, tmp_path):
    from stowline.streaming import retention

    schema = "ts timestamp, msg string"

    def store(rows, n):
        source = str(tmp_path / "in")
        spark.createDataFrame(rows, "t string, msg string").select(F.try_to_timestamp("t").alias("ts"), "msg").coalesce(1).write.mode("append").parquet(source)
        jobs.run_to_end(retention.store_days(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / f"cp{n}")))

    store([(f"2024-01-{d:02d} 10:00:00", f"m{d}") for d in (1, 2, 3, 5)] + [(None, "no time")], 0)
    out = tmp_path / "out"
    before = {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet")}
    assert retention.expire_days(spark, str(out), 2) == ["2024-01-01", "2024-01-02"]
    after = {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet")}
    assert len(after) == 3 and after.items() <= before.items()
    assert {p.name for p in out.glob("log_day=*")} == {"log_day=2024-01-03", "log_day=2024-01-05", "log_day=undated"}
    rows = {(r.msg, r.log_day) for r in retention.read_days(spark, str(out), schema).collect()}
    assert rows == {("m3", "2024-01-03"), ("m5", "2024-01-05"), ("no time", "undated")}
    assert retention.expire_days(spark, str(out), 2) == []
    # The same batch again, from a lost checkpoint, replaces its own folders.
    store([("2024-01-09 00:00:00", "m9")], 1)
    assert sorted(r.msg for r in retention.read_days(spark, str(out), schema).collect()) == ["m1", "m2", "m3", "m5", "m9", "no time"]
    with pytest.raises(ValueError):
        retention.expire_days(spark, str(out), 0)
