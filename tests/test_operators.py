"""Edge rows of single operators: NULL, ties, empty input, cycles, files on disk."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stowline.functions.content import UnsupportedDigest
from stowline.operators import acl, capacity, doctor, dups, identity, inventory, journal, observability
from stowline.plans import checks, placement
from stowline.sources import catalog, files, listings, logs
from stowline.workload import load_all
from stowline.workload.registry import QUERIES, Tables

FOLDER = "library_id long, ref string, parent_ref string"
ACL = "library_id long, ref string, principal string"


def chain(n):
    return [(0, f"f{i}", f"f{i - 1}" if i else None) for i in range(n)]


def test_deep_folders_and_nearest_public(spark):
    folders = spark.createDataFrame(chain(21), FOLDER)
    grants = spark.createDataFrame([(0, "f3", "Anyone"), (0, "f9", "anonymous"), (0, "f15", "User")], ACL)
    got = {r["ref"]: r["public_ref"] for r in acl.public_folders(folders, grants).collect()}
    assert got == {f"f{i}": None if i < 3 else ("f3" if i < 9 else "f9") for i in range(21)}
    pairs = acl.ancestors(folders)
    assert pairs.count() == 210 and pairs.filter("distance = 20").first()["ref"] == "f20"


def test_folder_cycle_raises(spark):
    loop = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "c", "a")], FOLDER)
    with pytest.raises(acl.FolderCycle):
        acl.ancestors(loop)


def test_own_grant_is_nearest(spark):
    items = spark.createDataFrame([(0, "x", "f1"), (0, "y", "f1"), (0, "z", None)], FOLDER)
    grants = spark.createDataFrame([(0, "x", "AnyoneWithLink"), (0, "f0", "Anyone")], ACL)
    got = {r["ref"]: r["public_at"] for r in acl.public_items(items, spark.createDataFrame(chain(2), FOLDER), grants).collect()}
    assert got == {"x": "x", "y": "f0"}


def test_listing_and_large_digests(spark, tmp_path):
    bodies = {"a.bin": b"abc", "b.bin": b"x" * (3 << 20), "empty.bin": b""}
    for name, body in bodies.items():
        (tmp_path / "deep" / "er").mkdir(parents=True, exist_ok=True)
        (tmp_path / "deep" / name if name == "b.bin" else tmp_path / name).write_bytes(body)
    (tmp_path / "other.txt").write_text("x")
    (tmp_path / "link.bin").symlink_to(tmp_path / "a.bin")
    listing = files.list_files(spark, [str(tmp_path)], "*.bin")
    assert {r["name"]: r["size"] for r in listing.collect()} == {n: len(b) for n, b in bodies.items()}
    rows = files.digest_large_files(listing, ["md5", "sha1"], partitions=2).collect()
    want = {n: (f"sha256:{hashlib.sha256(b).hexdigest()}", hashlib.md5(b).hexdigest(), hashlib.sha1(b).hexdigest()) for n, b in bodies.items()}
    assert {r["path"].rsplit("/", 1)[1]: (r["content_id"], r["md5"], r["sha1"]) for r in rows} == want
    with pytest.raises(UnsupportedDigest):
        files.digest_large_files(listing, ["quickxor"])


def test_catalog_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, "p"), (1, 2, "q")], "library_id long, file_id long, path string")
    catalog.write_catalog(rows, str(tmp_path), "files")
    back = catalog.read_catalog(spark, str(tmp_path), "files")
    assert {(r["library_id"], r["file_id"], r["path"], r["size"]) for r in back.collect()} == {(0, 1, "p", None), (1, 2, "q", None)}
    with pytest.raises(ValueError):
        catalog.conform(rows.withColumn("odd", F.lit(1)), "files")


def test_listings_survive_bad_rows(spark):
    bad = spark.createDataFrame([(0, "g", "not json"), (0, "g", '{"id":"a","ownedByMe":true,"size":"12x","mimeType":"text/plain"}')],
                                "library_id long, location_id string, json string")
    got = listings.normalise_drive(bad).collect()
    assert [(r["remote_ref"], r["size"], r["parent_ref"]) for r in got] == [("a", None, None)]


def test_log_lines(spark):
    lines = spark.createDataFrame([('{"ts":"2024-01-01T00:00:00Z","level":"INFO","target":"t","message":"m","n":5}',), ("oops",), ("{}",),
                                   ('{"ts":"never","msg":"x"}',)], "value string")
    got = logs.parse_log_lines(lines).collect()
    assert got[0]["msg"] == "m" and got[0]["fields"] == {"n": "5"} and got[0]["corrupt_line"] is None
    assert got[1]["corrupt_line"] == "oops" and got[2]["corrupt_line"] == "{}" and got[3]["ts"] is None and got[3]["msg"] == "x"


def test_prometheus_order_and_sink(spark, tmp_path):
    rollup = spark.createDataFrame([("z.b", "counter", 3.0), ("a-c", "gauge", 1.5), ("a.b", "counter", 2.0)], "name string, kind string, value double")
    text = observability.prometheus_text(rollup, "x_")
    logs.write_prometheus(text, str(tmp_path / "prom"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "prom")).collect()] == [
        "# TYPE x_a_b counter", "x_a_b 2", "# TYPE x_z_b counter", "x_z_b 3", "# TYPE x_a_c gauge", "x_a_c 1.5"]


@pytest.mark.parametrize("free,advice", [([(True, 4), (False, 50), (False, 500)], ("recommend", "v2")), ([(True, 8), (False, 500)], ("use_default", None)),
                                         ([(True, 4), (False, 5)], ("use_default", None)), ([(True, 4)], ("use_default", None))])
def test_recommend_volume(spark, free, advice):
    rows = [(1, f"v{i}", system, gib << 30) for i, (system, gib) in enumerate(free)]
    got = capacity.recommend_volume(spark.createDataFrame(rows, "host long, root string, is_system boolean, free_bytes long")).first()
    assert (got["advice"], got["root"]) == advice


def test_roots_match_whole_names_only(spark):
    rows = spark.createDataFrame([(0, 1, "D:\\Sync\\a"), (0, 2, "d:/sync"), (0, 3, "D:\\Syncer\\a"), (1, 4, "D:\\Sync\\a"), (0, 5, "top")],
                                 "library_id long, file_id long, path string")
    roots = spark.createDataFrame([(0, "D:\\SYNC\\")], "library_id long, path string")
    assert {r["file_id"] for r in inventory.exclude_roots(rows, roots).collect()} == {3, 4, 5}
    assert inventory.exclude_roots(rows, roots.filter("false")).count() == 5


REPLICA = "library_id long, blob_id long, file_id long, location_id string, location_kind string, size long, state string, hydration string, is_online boolean, pinned boolean"


def copies(spark, *rows):
    return spark.createDataFrame([(0, b, f, loc, "cloud" if loc == "c" else "volume", 1, state, hyd, online, False) for b, f, loc, state, hyd, online in rows], REPLICA)


@pytest.mark.parametrize("rows_per_bucket", [1, 1_000_000])
def test_extra_local_keeps_one(spark, rows_per_bucket):
    full = "local_full"
    rows = copies(spark, *[(1, i, "d", "verified", full, True) for i in range(5)], (2, 10, "d", "verified", full, True), (2, 11, "c", "verified", "cloud_native", True),
                  (3, 20, "d", "verified", full, True), (3, 21, "e", "suspect", full, True), (3, 22, "x", "verified", full, False), (3, 23, "p", "verified", "placeholder", True))
    got = {r["file_id"] for r in dups.extra_local(rows, rows_per_bucket=rows_per_bucket).collect()}
    assert got == {1, 2, 3, 4}


@pytest.mark.parametrize("rows_per_bucket", [1, 1_000_000])
def test_last_copy_guard(spark, rows_per_bucket):
    full = "local_full"
    rows = copies(spark, (1, 1, "d", "verified", full, True), (1, 2, "e", "verified", full, True), (2, 3, "d", "verified", full, True),
                  (2, 4, "c", "verified", "cloud_native", True), (3, 5, "d", "verified", full, True), (3, 6, "c", "suspect", "cloud_native", True))
    rows = rows.withColumn("binding", F.when(F.col("file_id") == 4, "changed").otherwise("bound"))
    got = {r["file_id"]: r["verdict"] for r in checks.authorise_delete(rows.select("library_id", "blob_id", "file_id"), rows, rows_per_bucket).collect()}
    assert got == {1: "permit", 2: "refused_last_copy", 3: "refused_last_copy", 4: "refused_not_local", 5: "refused_last_copy", 6: "refused_not_local"}


def test_merge_and_conflict(spark):
    replicas = spark.createDataFrame([(0, 1, 1, "suspect"), (0, 2, 2, "suspect"), (0, 3, 2, "suspect"), (0, 4, 4, "suspect"), (0, 5, 4, "suspect")],
                                     "library_id long, file_id long, blob_id long, state string")
    hashed = spark.createDataFrame([(0, 1, "s:a"), (0, 2, "s:a"), (0, 4, "s:b"), (0, 5, "s:c")], "library_id long, file_id long, content_id string")
    got = {r["file_id"]: (r["blob_id"], r["content_id"], r["state"], r["conflict"]) for r in identity.promote_verified(replicas, hashed).collect()}
    assert got == {1: (1, "s:a", "verified", False), 2: (1, "s:a", "verified", False), 3: (1, "s:a", "suspect", False),
                   4: (4, "s:b", "suspect", True), 5: (4, "s:c", "suspect", True)}


def test_every_allowed_edge_passes_the_audit(spark):
    path = ["ReservedSpace", "ParentAclChecked", "Transferring", "Verifying", "Verified", "AssertedPrivate", "DeletingSource", "SourceDeleted",
            "ReleasedSpace", "Committed"]
    rows = [(i, 1, s, f"2024-01-01 00:00:{i:02d}") for i, s in enumerate(path)] + [(50, 2, "Committed", "2024-01-01 00:00:00")]
    moves = spark.createDataFrame(rows, "event_id long, op_id long, state string, t string").withColumn("updated_at", F.col("t").cast("timestamp"))
    for rows_per_bucket in (2, 1_000_000):
        got = journal.transition_audit(moves, rows_per_bucket).collect()
        assert [(r["op_id"], r["from_state"], r["to_state"]) for r in got] == [(2, "NotStarted", "Committed")]


def test_audits_on_null_keys(spark):
    rows = spark.createDataFrame([(0, None), (0, 5), (0, 5), (0, 9)], "library_id long, k long")
    parents = spark.createDataFrame([(0, 9), (1, 5)], "library_id long, id long")
    assert [(r["missing_key"], r["rows"]) for r in doctor.orphans(rows, "k", parents, "id").collect()] == [("5", 2)]
    assert [(r["k"], r["rows"]) for r in doctor.duplicate_keys(rows, ["library_id", "k"]).collect()] == [(5, 2)]
    summary = doctor.doctor({"none": ("info", rows.filter("false"))}).first()
    assert (summary["violations"], summary["sample"]) == (0, None)


NUMBERED = "library_id long, location_id string, path string, size long, mtime_utc string, ntfs_file_id string, volume_serial string, hydration string"


def snap(spark, rows):
    return spark.createDataFrame([(0, "d", path, size, "t", number, "V", "local_full") for path, size, number in rows], NUMBERED)


@pytest.mark.parametrize("per_bucket", [1_000_000, 2])
def test_hard_links_are_paired_once(spark, per_bucket):
    old = snap(spark, [("/a", 1, "7"), ("/b", 1, "7"), ("/c", 1, "7"), ("/gone1", 2, "8"), ("/gone2", 2, "8"), ("/same", 3, None), ("/left", 4, "9")])
    new = snap(spark, [("/a", 1, "7"), ("/b2", 1, "7"), ("/c", 5, "7"), ("/d", 1, "7"), ("/now", 2, "8"), ("/same", 3, None), ("/fresh", 6, None)])
    rows = [tuple(r) for r in inventory.diff_snapshots(old, new, rows_per_bucket=per_bucket).collect()]
    by_path = {r[1]: r[2:] for r in rows}
    assert len(rows) == len(by_path) == 9
    assert by_path["/a"] == (None, "unchanged", False) and by_path["/c"] == (None, "changed", True) and by_path["/same"] == (None, "unchanged", False)
    assert sorted((by_path["/b2"][1], by_path["/d"][1])) == ["new", "renamed"] and {by_path["/b2"][0], by_path["/d"][0]} == {"/b", None}
    assert by_path["/now"][:2] in {("/gone1", "renamed"), ("/gone2", "renamed")}
    assert by_path["/left"][1] == "missing" and by_path["/fresh"][1] == "new"
    assert [p for p in ("/gone1", "/gone2") if p in by_path] and inventory.diff_snapshots(old.limit(0), new.limit(0)).count() == 0


def test_dirty_files_by_number_or_path(spark):
    known = snap(spark, [("/a", 1, "7"), ("/b", 1, "7"), ("/p", 2, None), ("/q", 2, None), ("/n", None, "3")]).withColumn(
        "content_id", F.when(F.col("path") != "/q", F.lit("sha256:x")))
    files = snap(spark, [("/a", 1, "7"), ("/moved", 1, "7"), ("/p", 2, None), ("/q", 2, None), ("/r", 2, None), ("/b", 9, "7"), ("/n", None, "3")])
    assert sorted(r.path for r in identity.dirty_files(files, known).collect()) == ["/b", "/q", "/r"]


MERGE_ROW = "library_id long, file_id long, origin long, digest string, blob_id long, state string, conflict boolean"


def merge_in_runs(spark, origins, runs):
    """Group of files per content after each listed run; files of a later run appear with it."""
    replicas, blobs = spark.createDataFrame([], MERGE_ROW), spark.createDataFrame([], "library_id long, content_id string, blob_id long")
    seen = set()
    for files, digests in runs:
        fresh = [(0, f, origins[f], None, None, "suspect", False) for f in files if f not in seen]
        seen |= set(files)
        replicas = replicas.unionByName(spark.createDataFrame(fresh, MERGE_ROW))
        hashed = spark.createDataFrame([(0, f, c) for f, c in digests.items()], "library_id long, file_id long, content_id string")
        replicas, blobs = identity.merge_run(replicas, hashed, blobs)
    return {r.file_id: (r.blob_id, r.state, r.conflict) for r in replicas.collect()}, {(r.content_id, r.blob_id) for r in blobs.collect()}


def test_runs_of_digests_merge_to_the_same_groups(spark):
    origins = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 4}
    digests = {1: "A", 3: "A", 4: "B", 5: "C", 6: "D", 8: "B"}
    every = list(origins)
    one, named = merge_in_runs(spark, origins, [(every, digests)])
    assert one == {1: (1, "verified", False), 2: (1, "suspect", False), 3: (1, "verified", False), 4: (4, "verified", False), 9: (4, "suspect", False),
                   8: (4, "verified", False), 5: (5, "verified", True), 6: (6, "verified", True), 7: (7, "suspect", True)}
    assert named == {("A", 1), ("B", 4), ("C", 5), ("D", 6)}
    splits = [[([1, 2, 3, 4], {1: "A", 3: "A"}), (every, {4: "B", 5: "C", 6: "D", 8: "B"})],
              [(every, {1: "A", 4: "B", 5: "C"}), (every, {6: "D"}), (every, {3: "A", 8: "B"}), (every, {})]]
    for runs in splits:
        got, ids = merge_in_runs(spark, origins, runs)
        assert got == one and ids == named
    # A content that is known keeps its blob, also when an older origin turns up for it later.
    later, ids = merge_in_runs(spark, origins, [(every, {3: "A"}), (every, {1: "A"})])
    assert ids == {("A", 3)} and later[1] == (3, "verified", False) and later[2] == (3, "suspect", False)


def test_promote_verified_ignores_old_ids(spark):
    replicas = spark.createDataFrame([(0, 1, 1, "suspect", "old")], "library_id long, file_id long, blob_id long, state string, content_id string")
    hashed = spark.createDataFrame([(0, 1, "new")], "library_id long, file_id long, content_id string")
    assert [(r.content_id, r.state) for r in identity.promote_verified(replicas, hashed).collect()] == [("new", "verified")]


def test_paths_inside_texts(spark):
    paths = ["/Videos/Captures/clip-1.mp4", "/Videos/Captures/clip-10.mp4", "/Videos/Captures/clip-1", "D:\\Data\\x.bin", "/a", "plain.txt", "/Thumbs.db",
             "/very/long/shared/folder/name/that/goes/on/and/on/and/on/and/on/file-000001.txt", "/very/long/shared/folder/name/that/goes/on/and/on/and/on/and/on/file-000002.txt"]
    files = spark.createDataFrame([(p,) for p in [*paths, "", paths[0]]], "path string")
    texts = ["moved /Videos/Captures/clip-10.mp4, done", "x/Videos/Captures/clip-1.mp4x", "see D:\\Data\\x.bin and /a/b", "plain.txt", "a plain.txt", "////a//",
             f"both {paths[7]} {paths[8]}", None, "", "/Videos/Captures/other.mp4", "/Thumbs.d"]
    rows = [(i, "INFO", t, {"f": (t or "")[::-1], "g": t}) for i, t in enumerate(texts)] + [(99, "debug", paths[0], {"f": paths[0]})]
    logs = spark.createDataFrame(rows, "log_id long, level string, msg string, fields map<string,string>")
    got = {(r.log_id, r.field, r.path) for r in observability.path_leak_audit(logs, files).collect()}
    anchored = {p for p in paths if p not in ("/a", "plain.txt")}
    want = set()
    for i, _, msg, fields in rows[:-1]:
        for name, value in [("msg", msg), *fields.items()]:
            want |= {(i, name, p) for p in paths if value is not None and (p in value if p in anchored else p == value)}
    assert got == want and (3, "msg", "plain.txt") in got and (0, "msg", "/Videos/Captures/clip-1") in got
    assert observability.path_leak_audit(logs, files.limit(0)).count() == 0


def test_shared_prefixes_are_no_anchor(spark):
    paths = spark.createDataFrame([(f"/common/folder/of/all/files/n{i:04d}.dat",) for i in range(300)], "path string")
    grams = [r.gram for r in observability.path_anchors(paths).collect()]
    assert len(grams) == 300 and max(grams.count(g) for g in set(grams)) <= 10


def test_a_tie_of_change_numbers(spark):
    base = spark.createDataFrame([(0, "d", "k", 1)], "library_id long, location_id string, item_key string, size long")
    changes = spark.createDataFrame([(0, "d", "k", 5, 3, False), (0, "d", "k", None, 3, True)], "library_id long, location_id string, item_key string, size long, change_no long, is_deleted boolean")
    assert inventory.apply_delta(base, changes).count() == 0


def test_ops_of_two_libraries_are_apart(spark):
    rows = [(0, 1, 1, "p", "ReservedSpace", "2024-01-01"), (1, 1, 2, "p", "Committed", "2024-01-02"), (0, 1, 3, "p", "Transferring", "2024-01-03")]
    frame = spark.createDataFrame(rows, "library_id long, op_id long, event_id long, plan_id string, state string, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))
    assert {(r.library_id, r.state) for r in journal.latest_state(frame).collect()} == {(0, "Transferring"), (1, "Committed")}
    assert [(r.library_id, r.to_state) for r in journal.transition_audit(frame).collect()] == [(1, "Committed")]


def test_ancestors_takes_every_folder(spark, tmp_path):
    rows = {"region": ([(3, "x")], "r_regionkey long, r_name string"), "nation": ([(1, 3), (2, 9)], "n_nationkey long, n_regionkey long"),
            "customer": ([(7, 1, "m"), (20, 2, "m"), (21, 5, "m")], "c_custkey long, c_nationkey long, c_mktsegment string")}
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    load_all()
    got = {(r["ref"], r["ancestor"], r["distance"]) for r in QUERIES["ancestors"](Tables(spark, str(tmp_path))).collect()}
    assert got == {("n1", "r3", 1), ("n2", "r9", 1), ("c7", "n1", 1), ("c20", "n2", 1), ("c21", "n5", 1), ("c7", "r3", 2), ("c20", "r9", 2)}


def join_spy(monkeypatch, module, name):
    """Whether the plan of the first frame given to ``module.name`` holds a join, per call."""
    seen, real = [], getattr(module, name)

    def spy(df, *args, **kwargs):
        seen.append("Join" in df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(module, name, spy)
    return seen


REPLICAS = "library_id long, blob_id long, file_id long, location_id long, location_kind string, hydration string, state string, is_online boolean, size long, binding string"


def test_evicts_meet_their_replicas_once(spark, monkeypatch):
    rows = spark.createDataFrame([(0, b, 10 * b + k, k, "volume", "local_full", "verified", True, 5, None) for b in range(4) for k in range(b + 1)], REPLICAS)
    seen = [join_spy(monkeypatch, checks, name) for name in ("order_buckets", "skew_join")]
    out = checks.authorise_delete(rows.select("library_id", "blob_id", "file_id"), rows)
    got = {r["file_id"]: r["verdict"] for r in out.collect()}
    assert got == {10 * b + k: "permit" if k < b else "refused_last_copy" for b in range(4) for k in range(b + 1)}
    assert seen == [[False], [False]]


def test_evict_candidates_outside_the_goals_are_found_once(spark, monkeypatch):
    rows = spark.createDataFrame([(0, b, 10 * b + k, k, "volume", "local_full", "verified", True, 5, None) for b in range(4) for k in range(b + 1)], REPLICAS)
    goals = spark.createDataFrame([(0, b, 0) for b in range(4)], "library_id long, blob_id long, dest long")
    needs = spark.createDataFrame([], "library_id long, blob_id long, dest_kind string, no_source boolean")
    policy_rows = spark.createDataFrame([(0, b, False, 1) for b in range(4)], "library_id long, blob_id long, pin_local boolean, min_replicas int")
    seen = join_spy(monkeypatch, placement, "skew_join")
    got = {r["file_id"] for r in placement.can_evict(goals, rows, needs, policy_rows).collect()}
    assert got == {10 * b + k for b in range(4) for k in range(1, b + 1)}
    assert seen == [False]
