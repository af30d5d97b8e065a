"""Cloud listings: paths over damaged trees, permissions, change feeds, and who may see what."""

import json

import pytest
from pyspark.sql import functions as F

from stowline.operators import acl, inventory, tree
from stowline.sources import listings, permissions

ITEM = "library_id long, location_id string, remote_ref string, parent_ref string, name string, kind string"
JSON = "library_id long, location_id string, json string"
FOLDER = "library_id long, ref string, parent_ref string"
ACL = "library_id long, ref string, principal string"


def paths(spark, rows, roots=None):
    items = spark.createDataFrame([(0, "d", *r) for r in rows], ITEM)
    tops = None if roots is None else spark.createDataFrame([(0, "d", r) for r in roots], "library_id long, location_id string, remote_ref string")
    return {r.remote_ref: (r.path, r.path_verdict, r.stopped_at) for r in tree.cloud_paths(items, tops).collect()}


def test_paths_of_a_deep_chain(spark):
    n = 70
    rows = [(f"f{i}", f"f{i - 1}" if i else None, f"n{i}", "directory") for i in range(n)] + [("x", f"f{n - 1}", "x.txt", "byte")]
    got = paths(spark, rows)
    assert got["x"] == ("/" + "/".join(f"n{i}" for i in range(n)) + "/x.txt", "ok", None)
    assert got["f0"] == ("/n0", "ok", None)


def test_verdicts(spark):
    rows = [("a", "top", "A/B", "directory"), ("b", "a", None, "directory"), ("c", "b", "c.txt", "byte"),
            ("l1", "l2", "l1", "directory"), ("l2", "l3", "l2", "directory"), ("l3", "l1", "l3", "directory"), ("under", "l2", "u", "directory"),
            ("u", "under", "u.txt", "byte"), ("self", "self", "s", "directory"), ("m", "gone", "m", "directory"), ("n", "m", "n", "directory"),
            ("o", "n", "o.txt", "byte"), ("p", "c", "p.txt", "byte"), ("q", None, "", "byte")]
    got = paths(spark, rows, ["top", "unused"])
    assert got["a"] == ("/A_B", "ok", None) and got["c"] == ("/A_B/b/c.txt", "ok", None) and got["q"] == ("/q", "ok", None)
    for ref, at in {"l1": "l2", "l2": "l3", "under": "l2", "u": "under", "self": "self"}.items():
        assert got[ref] == (None, "cycle", at)
    assert got["m"] == (None, "missing_parent", "gone") and got["o"] == (None, "missing_parent", "gone")
    assert got["p"] == (None, "missing_parent", "c")
    assert paths(spark, rows)["a"] == (None, "missing_parent", "top")


def test_paths_keep_rows_columns_and_drives_apart(spark):
    rows = [(0, "d", "f", None, "one", "directory"), (0, "e", "f", None, "two", "directory"), (1, "d", "f", "f2", "three", "directory"),
            (0, "d", "x", "f", "x", "byte"), (0, "e", "x", "f", "x", "byte"), (1, "d", "x", "f", "x", "byte"), (0, "d", "x", "f", "x", "byte"),
            (0, "d", "f", "zz", "listed again", "directory")]
    items = spark.createDataFrame(rows, ITEM).withColumn("mark", F.lit(7))
    got = tree.cloud_paths(items).collect()
    assert len(got) == 8 and all(r.mark == 7 for r in got)
    assert sorted((r.library_id, r.location_id, r.path or "") for r in got if r.remote_ref == "x") == [(0, "d", "/one/x"), (0, "d", "/one/x"), (0, "e", "/two/x"), (1, "d", "")]
    assert tree.cloud_paths(items.limit(0)).count() == 0


def test_a_hot_folder_is_met_in_place(spark, monkeypatch):
    from stowline import scale

    monkeypatch.setattr(scale, "ROWS_PER_BUCKET", 5)
    rows = [("top", None, "t", "directory")] + [(f"d{i}", "top", f"d{i}", "directory") for i in range(20)] + [(f"x{i}", "top", f"x{i}", "byte") for i in range(60)]
    got = paths(spark, rows)
    assert len(got) == 81 and got["d7"] == ("/t/d7", "ok", None) and got["x9"] == ("/t/x9", "ok", None)


def test_listing_times_and_graph_roots(spark):
    drive = spark.createDataFrame([(0, "g", json.dumps({"id": "a", "ownedByMe": True, "modifiedTime": "2024-02-03T04:05:06.789Z", "mimeType": "text/plain"})),
                                   (0, "g", json.dumps({"id": "b", "ownedByMe": True, "modifiedTime": "yesterday", "mimeType": "text/plain"}))], JSON)
    got = {r.remote_ref: r.ms for r in listings.normalise_drive(drive).select("remote_ref", F.unix_millis("mtime_utc").alias("ms")).collect()}
    assert got == {"a": 1706933106789, "b": None}
    graph = spark.createDataFrame([(0, "o", json.dumps({"id": "r", "root": {}, "folder": {"childCount": 1}, "lastModifiedDateTime": "2024-02-03T04:05:06Z"})),
                                   (0, "o", json.dumps({"id": "f", "name": "F", "folder": {"childCount": 0}, "parentReference": {"id": "r"}})),
                                   (0, "o", json.dumps({"id": "x", "name": "x", "parentReference": {"id": "f"}}))], JSON)
    rows = listings.normalise_graph(graph)
    found = {r.remote_ref: r.path for r in tree.cloud_paths(rows, listings.graph_roots(rows)).collect()}
    assert found == {"r": "/", "f": "/F", "x": "/F/x"}


def test_permissions_fail_closed(spark):
    rows = [(0, "g", json.dumps({"id": "none"})), (0, "g", json.dumps({"id": "empty", "permissions": []})), (0, "g", "not json"),
            (0, "g", json.dumps({"id": "odd", "permissions": [{"type": None, "role": "reader"}]})),
            (0, "g", json.dumps({"id": "details", "permissions": [{"type": "anyone", "id": "anyoneWithLink", "role": "reader", "permissionDetails": []}]}))]
    got = sorted((r.remote_ref, r.principal, r.role) for r in permissions.drive_permissions(spark.createDataFrame(rows, JSON)).collect())
    assert got == [("details", "AnyoneWithLink", "reader"), ("none", "Unknown", None), ("odd", "Unknown", "reader")]
    graph = [(0, "o", json.dumps({"id": "a", "permissions": [{"link": {"type": "view"}}]})), (0, "o", json.dumps({"id": "b", "permissions": [{}]})),
             (0, "o", json.dumps({"id": "c", "permissions": [{"roles": ["write"], "grantedToV2": {"siteUser": {"id": "1"}}}]}))]
    got = sorted((r.remote_ref, r.principal, r.role) for r in permissions.graph_permissions(spark.createDataFrame(graph, JSON)).collect())
    assert got == [("a", "Unknown", "reader"), ("b", "Unknown", None), ("c", "User", "writer")]
    with pytest.raises(ValueError):
        permissions.normalise_permissions(None, None)


def test_exposure_is_private_only_when_all_is_known(spark):
    folders = spark.createDataFrame([(0, "root", None), (0, "pub", "root"), (0, "in_pub", "pub"), (0, "lost", "gone"), (0, "below", "lost"), (0, "hid", "root"),
                                     (0, "l1", "l2"), (0, "l2", "l1"), (0, "both", "hid2"), (0, "hid2", "pub")], FOLDER)
    grants = spark.createDataFrame([(0, "pub", " ANYONE "), (0, "hid", "Unknown"), (0, "own", "anonymous"), (0, "hid2", "unknown"), (0, "z", "Unknown")], ACL)
    items = spark.createDataFrame([(0, "a", "in_pub"), (0, "b", "below"), (0, "c", "hid"), (0, "d", "l1"), (0, "e", "root"), (0, "f", "nowhere"), (0, "own", "root"),
                                   (0, "g", None), (0, "h", "both"), (0, "z", None)], FOLDER)
    got = {r.ref: (r.exposure, r.public_at, r.unresolved_at) for r in acl.exposure(items, folders, grants).collect()}
    assert got == {
        "a": ("public", "pub", None), "b": ("unresolved", None, "gone"), "c": ("unresolved", None, "hid"), "d": ("unresolved", None, "l1"),
        "e": ("private", None, None), "f": ("unresolved", None, "nowhere"), "own": ("public", "own", None), "g": ("private", None, None),
        "h": ("public", "pub", None), "z": ("unresolved", None, "z")}
    ops = spark.createDataFrame([(0, 1, "in_pub"), (0, 2, "below"), (0, 3, "root"), (0, 4, "nowhere"), (0, 5, None)], "library_id long, op_id long, dest_parent string")
    refused = {r.op_id: (r.exposure, r.public_at, r.unresolved_at) for r in acl.refused_destinations(ops, folders, grants).collect()}
    assert refused == {1: ("public", "pub", None), 2: ("unresolved", None, "gone"), 4: ("unresolved", None, "nowhere"), 5: ("unresolved", None, None)}


def test_an_upload_that_no_listing_holds_is_told(spark):
    ops = spark.createDataFrame([(0, "p", 1, 10, "upload_keep", "x"), (0, "p", 1, 11, "upload_keep", "gone"), (0, "p", 1, 12, "evict", "gone"), (0, "o", 0, 13, "upload_keep", "gone")],
                                "library_id long, plan_id string, created_at long, op_id long, kind string, dest_ref string")
    items = spark.createDataFrame([(0, "x", None)], FOLDER)
    got = acl.upload_acl_recheck(ops, items, spark.createDataFrame([], FOLDER), spark.createDataFrame([], ACL)).collect()
    assert [(r.op_id, r.exposure, r.unresolved_at) for r in got] == [(11, "unresolved", "gone")]


def test_change_feed_and_cursors(spark):
    def entry(i, **more):
        return {"changeType": "file", "fileId": i, "removed": False, "file": {"id": i, "name": i, "ownedByMe": True, "mimeType": "text/plain", "size": "5", **more}}

    first = [entry("a"), entry("b"), {"changeType": "file", "fileId": "c", "removed": True}, {"changeType": "drive", "driveId": "x"}, {"removed": True}]
    second = [entry("a", size="6"), entry("b", trashed=True), entry("d", ownedByMe=False), entry("e", mimeType="application/vnd.google-apps.document")]
    pages = [(0, "g", 0, json.dumps({"changes": first, "nextPageToken": "n"})), (0, "g", 1, json.dumps({"changes": second, "newStartPageToken": "t9"})),
             (0, "h", 0, json.dumps({"changes": [], "nextPageToken": "n"})), (0, "i", 0, "broken")]
    feed = spark.createDataFrame(pages, "library_id long, location_id string, page_no int, json string")
    rows = {(r.item_key, r.change_no): (r.is_deleted, r["size"]) for r in listings.drive_changes(feed).collect()}
    page = 1 << 20
    assert rows == {("a", 0): (False, 5), ("b", 1): (False, 5), ("c", 2): (True, None), ("a", page): (False, 6), ("b", page + 1): (True, 5),
                    ("d", page + 2): (True, 5), ("e", page + 3): (True, 5)}
    base = spark.createDataFrame([(0, "g", "b", 1), (0, "g", "c", 1), (0, "g", "z", 1)], "library_id long, location_id string, item_key string, size long")
    assert {r.item_key: r["size"] for r in inventory.apply_delta(base, listings.drive_changes(feed)).collect()} == {"a": 6, "z": 1}
    cursors = {r.provider_id: (r.cursor, r.complete) for r in listings.feed_cursors(feed, "drive").collect()}
    assert cursors == {"g": ("t9", True), "h": (None, False), "i": (None, False)}
