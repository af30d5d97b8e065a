"""Explicit schemas of the catalog tables; nothing is inferred."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "providers": "library_id BIGINT, id STRING, kind STRING, account STRING, config MAP<STRING,STRING>, created_at TIMESTAMP",
    "locations": "library_id BIGINT, location_id STRING, provider_id STRING, kind STRING, label STRING, root STRING, "
                 "volume_serial STRING, removable BOOLEAN, roles ARRAY<STRING>, is_online BOOLEAN",
    "overlay_roots": "library_id BIGINT, path STRING, provider_id STRING, detector STRING",
    "scans": "library_id BIGINT, id BIGINT, provider_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP, "
             "files_seen BIGINT, status STRING",
    "files": "library_id BIGINT, file_id BIGINT, location_id STRING, parent_id BIGINT, path STRING, name STRING, "
             "kind STRING, shortcut_target_ref STRING, is_dir BOOLEAN, size BIGINT, mtime_utc TIMESTAMP, "
             "ntfs_file_id STRING, volume_serial STRING, attrs INT, reparse_tag BIGINT, mime STRING, "
             "hydration STRING, remote_ref STRING, last_scan_id BIGINT",
    "blobs": "library_id BIGINT, blob_id BIGINT, content_id STRING, size BIGINT, mime STRING, duration_ms BIGINT, "
             "width INT, height INT",
    "replicas": "library_id BIGINT, id BIGINT, blob_id BIGINT, file_id BIGINT, state STRING",
    "provider_checksums": "library_id BIGINT, provider_id STRING, remote_ref STRING, algo STRING, hex STRING, "
                          "size BIGINT, blob_id BIGINT",
    "scan_cursors": "library_id BIGINT, provider_id STRING, cursor STRING, full_scan_at TIMESTAMP, last_scan_at TIMESTAMP",
    "capacity_snapshots": "library_id BIGINT, id BIGINT, location_id STRING, total_bytes BIGINT, used_bytes BIGINT, "
                          "free_bytes BIGINT, quota_bytes BIGINT, measured_at TIMESTAMP",
    "collections_cache": "library_id BIGINT, file_id BIGINT, collection STRING",
    "plans": "library_id BIGINT, plan_id STRING, created_at TIMESTAMP, status STRING, summary STRING, "
             "min_residual BIGINT, staging_reserve BIGINT",
    "plan_ops": "library_id BIGINT, plan_id STRING, seq BIGINT, op_id STRING, kind STRING, blob_id BIGINT, "
                "file_id BIGINT, size BIGINT, src STRING, dest STRING, residual_during MAP<STRING,BIGINT>, "
                "residual_after MAP<STRING,BIGINT>, rollback_note STRING",
    "journal_ops": "library_id BIGINT, op_id STRING, plan_id STRING, state STRING, offset BIGINT, tmp_path STRING, "
                   "session_uri STRING, we_created BOOLEAN, dest_remote_ref STRING, error STRING, updated_at TIMESTAMP",
    "apply_log": "library_id BIGINT, id BIGINT, plan_id STRING, op_id STRING, level STRING, message STRING, at TIMESTAMP",
    "folders": "library_id BIGINT, remote_ref STRING, parent_ref STRING",
    "acl_entries": "library_id BIGINT, remote_ref STRING, principal STRING, role STRING, inherited BOOLEAN, "
                   "inherited_from STRING",
}


def columns(table: str) -> list[tuple[str, str]]:
    """Name and type of each column of a table, in order."""
    return [tuple(column.split(" ", 1)) for column in TABLES[table].split(", ")]


# Allowed words of the enum columns.
ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("files", "kind"): ("byte", "directory", "shortcut"),
    ("files", "hydration"): ("local_full", "placeholder", "cloud_native"),
    ("replicas", "state"): ("verified", "suspect", "partial"),
    ("locations", "kind"): ("volume", "cloud"),
    ("scans", "status"): ("running", "ok", "error"),
    ("plan_ops", "kind"): ("upload_keep", "upload_evict", "evict", "download", "shuttle", "ingest"),
}

# (child table, child column, parent table, parent column); all are scoped to one library.
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("locations", "provider_id", "providers", "id"),
    ("scans", "provider_id", "providers", "id"),
    ("files", "location_id", "locations", "location_id"),
    ("files", "parent_id", "files", "file_id"),
    ("files", "last_scan_id", "scans", "id"),
    ("replicas", "blob_id", "blobs", "blob_id"),
    ("replicas", "file_id", "files", "file_id"),
    ("provider_checksums", "provider_id", "providers", "id"),
    ("provider_checksums", "blob_id", "blobs", "blob_id"),
    ("scan_cursors", "provider_id", "providers", "id"),
    ("capacity_snapshots", "location_id", "locations", "location_id"),
    ("collections_cache", "file_id", "files", "file_id"),
    ("plan_ops", "plan_id", "plans", "plan_id"),
    ("plan_ops", "blob_id", "blobs", "blob_id"),
    ("plan_ops", "file_id", "files", "file_id"),
    ("journal_ops", "plan_id", "plans", "plan_id"),
)

UNIQUE_KEYS: dict[str, tuple[str, ...]] = {
    "providers": ("library_id", "id"),
    "locations": ("library_id", "location_id"),
    "files": ("library_id", "location_id", "path"),
    "blobs": ("library_id", "content_id"),
    "replicas": ("library_id", "file_id"),
    "provider_checksums": ("library_id", "provider_id", "remote_ref", "algo"),
    "collections_cache": ("library_id", "file_id", "collection"),
    "plan_ops": ("library_id", "plan_id", "seq"),
    "journal_ops": ("library_id", "op_id"),
}
