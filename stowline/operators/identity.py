"""Content identity: digests, proto-blobs, checksum bindings and verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.functions.content import content_id, digests, head_digest, head_length, normal_id
from stowline.operators.inventory import stable_key
from stowline.scale import skew_join
from stowline.session import cut_lineage

BLOB_KEY = ["library_id", "blob_id"]


def multi_digest(df: DataFrame, algos: Sequence[str], content: str = "content") -> DataFrame:
    """Content id and native digests in one projection over the body; an unknown algorithm raises."""
    body = F.col(content)
    return df.select(*[c for c in df.columns if c != content], content_id(body).alias("content_id"), *digests(body, algos))


def quick_hash(df: DataFrame, content: str = "content") -> DataFrame:
    """Full size, digest of the first 64 KiB and the bytes it covered."""
    body = F.col(content).cast("binary")
    size = F.col("size") if "size" in df.columns else F.octet_length(body).cast("long")
    rest = [c for c in df.columns if c not in (content, "size")]
    return df.select(*rest, size.alias("size"), head_digest(body).alias("head"), head_length(body).alias("head_len"))


def prefilter_candidates(probes: DataFrame) -> DataFrame:
    """Rows that share (size, head) with another: only these need a full digest.

    The probes are stored first, as each body must be read once only. The groups are found by an aggregate that reduces
    before its shuffle; the rows come back by a semi-join that leaves the rows of hot groups in place.
    """
    probes = cut_lineage(probes)
    shared = probes.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size", "head")
    return skew_join(probes, shared, ["size", "head"], "left_semi")


def validate_content_id(df: DataFrame, column: str = "content_id") -> DataFrame:
    """Lower-case id in ``content_id`` where valid; ``is_valid`` marks the rejects."""
    raw = F.col(column)
    return df.withColumn("is_valid", normal_id(raw).isNotNull()).withColumn("content_id", normal_id(raw))


def dirty_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """``local_full`` files that need a digest: never hashed, or file number, size or time differ.

    A file goes by its number on the volume, else by its location and path; of several paths of one file any that was hashed
    with this size and time will do. One anti-join on the whole key, so a file never comes twice.
    """
    state = ["library_id", "_space", "_item", "_size", "_mtime"]
    stamp = [F.coalesce(F.col("size").cast("string"), F.lit("-")).alias("_size"),
             F.coalesce(F.col("mtime_utc").cast("string"), F.lit("-")).alias("_mtime")]
    hashed = known.filter(F.col("content_id").isNotNull()).select("library_id", *stable_key(), *stamp).distinct()
    local = files.filter(F.col("hydration") == "local_full").select("*", *stable_key(), *stamp)
    return local.join(hashed, state, "left_anti").select(*files.columns)


def attach_bindings(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """Files whose (provider, algo, hex, size) is bound to a blob, with the lowest such blob id.

    The bindings are reduced to one blob per digest before the join, so copies never multiply; a digest that very many
    files have is met in place.
    """
    key = ["library_id", "provider_id", "algo", "hex", "size"]
    bound = checksums.filter(F.col("blob_id").isNotNull()).groupBy(*key).agg(F.min("blob_id").alias("blob_id"))
    hits = skew_join(files.select("library_id", "provider_id", "file_id", "algo", "hex", "size"), bound, key, "inner")
    return hits.groupBy("library_id", "file_id").agg(F.min("blob_id").alias("blob_id")).withColumn(
        "state", F.lit("suspect"))


def assign_proto_blobs(files: DataFrame, attached: DataFrame) -> DataFrame:
    """A blob of its own (id = file id, no content id yet) for each byte file without a binding."""
    fresh = files.filter(F.col("kind") == "byte").join(
        attached.select("library_id", "file_id"), ["library_id", "file_id"], "left_anti")
    return fresh.select(
        "library_id", F.col("file_id").alias("blob_id"), "file_id", F.lit(None).cast("string").alias("content_id"),
        "size", F.lit("suspect").alias("state"),
    )


def promote_verified(replicas: DataFrame, hashed: DataFrame) -> DataFrame:
    """Set the content id of hashed ``local_full`` files, mark them verified, and merge blobs of equal id.

    ``hashed`` holds (library_id, file_id, content_id). A blob takes the id of its hashed replica, so
    replicas that were not hashed follow the merge but keep their state. The lowest blob id survives.
    A blob whose replicas hash to different ids is left alone and flagged as ``conflict``.
    """
    known = replicas.drop("content_id").join(hashed, ["library_id", "file_id"], "left")
    of_blob = known.filter(F.col("content_id").isNotNull()).groupBy(*BLOB_KEY).agg(
        F.min("content_id").alias("_cid"), (F.min("content_id") != F.max("content_id")).alias("_split"))
    clean = of_blob.filter(~F.col("_split"))
    canonical = clean.groupBy("library_id", "_cid").agg(F.min("blob_id").alias("_canonical"))
    fate = clean.join(canonical, ["library_id", "_cid"]).select(*BLOB_KEY, "_cid", "_canonical", "_split").unionByName(
        of_blob.filter("_split").select(*BLOB_KEY, F.lit(None).cast("string").alias("_cid"),
                                        F.lit(None).cast("long").alias("_canonical"), "_split"))
    out = skew_join(known.withColumn("_hashed", F.col("content_id").isNotNull()), fate, BLOB_KEY, "left")
    conflict = F.coalesce("_split", F.lit(False))
    return out.select(
        "library_id", "file_id", F.coalesce("_canonical", "blob_id").alias("blob_id"),
        F.coalesce("_cid", "content_id").alias("content_id"),
        F.when(F.col("_hashed") & ~conflict, F.lit("verified")).otherwise(F.col("state")).alias("state"),
        conflict.alias("conflict"),
    )


def merge_run(replicas: DataFrame, hashed: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge the digests of one run into the stored tables; gives the new ``replicas`` and ``blobs``.

    ``replicas``: (library_id, file_id, origin, digest, blob_id, state, conflict), where ``origin`` is the blob that the file
    was listed with, and a file new in this run has a NULL ``blob_id``. ``hashed``: (library_id, file_id, content_id), of which
    the greatest counts. ``blobs``: (library_id, content_id, blob_id), one row per content, which earlier runs gave.

    A digest tells its file's content for good, so a hashed file belongs to the blob of that content. Its unhashed
    siblings of the same origin follow, still suspect, while the origin's digests agree; when they part, the siblings fall
    back to blobs of their own (id = file id) and the origin's files are flagged ``conflict``. A content that is stored keeps
    its blob id; a new one takes its lowest agreeing origin, or else its lowest file id. Only files of origins that the run
    touches are computed again, so a run costs what it changes; runs in any split give the same groups of files.
    """
    file, source = ["library_id", "file_id"], ["library_id", "origin"]
    fresh = hashed.filter(F.col("content_id").isNotNull()).groupBy(*file).agg(F.max("content_id").alias("_new"))
    seen = cut_lineage(replicas.join(fresh, file, "left"))
    touched = cut_lineage(seen.filter(F.col("_new").isNotNull() | F.col("blob_id").isNull()).select(*source).distinct())
    rest = skew_join(seen, touched, source, "left_anti").drop("_new")
    open_rows = cut_lineage(skew_join(seen, touched, source, "left_semi").withColumn("digest", F.coalesce("_new", "digest")).drop("_new"))
    told = open_rows.filter(F.col("digest").isNotNull())
    fate = told.groupBy(*source).agg(F.min("digest").alias("_only"), (F.min("digest") != F.max("digest")).alias("_split"))
    named = skew_join(told, fate, source, "inner").groupBy("library_id", F.col("digest").alias("content_id")).agg(
        F.coalesce(F.min(F.when(~F.col("_split"), F.col("origin"))), F.min("file_id")).alias("blob_id"))
    all_blobs = cut_lineage(blobs.unionByName(named.join(blobs, ["library_id", "content_id"], "left_anti").select(*blobs.columns)))
    placed = skew_join(open_rows, fate, source, "left").withColumn("_split", F.coalesce("_split", F.lit(False)))
    placed = placed.withColumn("content_id", F.coalesce("digest", F.when(~F.col("_split"), F.col("_only"))))
    ids = all_blobs.select("library_id", "content_id", F.col("blob_id").alias("_blob"))
    keyed = skew_join(placed.filter(F.col("content_id").isNotNull()), ids, ["library_id", "content_id"], "left").unionByName(
        placed.filter(F.col("content_id").isNull()).withColumn("_blob", F.lit(None).cast("long")))
    done = keyed.select(
        *file, "origin", "digest", F.coalesce(F.col("_blob"), F.when(F.col("_split"), F.col("file_id")).otherwise(F.col("origin"))).alias("blob_id"),
        F.when(F.col("digest").isNotNull(), "verified").otherwise("suspect").alias("state"), F.col("_split").alias("conflict"))
    return cut_lineage(rest.select(*done.columns).unionByName(done)), all_blobs


def verify_native(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Per op: ``match`` needs at least one shared algorithm and all shared ones equal."""
    have = returned.select("op_id", "algo", F.lower("hex").alias("_got")).filter(F.col("_got").isNotNull())
    pairs = expected.select("op_id", "algo", F.lower("hex").alias("_want")).join(have, ["op_id", "algo"], "left")
    shared = F.count("_got")
    per_op = pairs.groupBy("op_id").agg(
        shared.alias("shared"),
        F.coalesce(F.bool_and(F.when(F.col("_got").isNotNull(), F.col("_got") == F.col("_want"))), F.lit(True)).alias("_ok"))
    verdict = (
        F.when(F.col("shared") == 0, "native_hash_missing").when(F.col("_ok"), "match").otherwise("mismatch")
    )
    return per_op.select("op_id", "shared", verdict.alias("verdict"))


def recheck_binding(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Per stored binding: whether the latest stat still shows the same digest and size."""
    key = ["library_id", "provider_id", "remote_ref", "algo"]
    now = current.select(*key, F.lower("hex").alias("_hex"), F.col("size").alias("_size"), F.lit(True).alias("_seen"))
    joined = stored.join(now, key, "left")
    same = F.col("_hex").eqNullSafe(F.lower("hex")) & F.col("_size").eqNullSafe(F.col("size"))
    status = F.when(F.col("_seen").isNull(), "gone").when(same, "bound").otherwise("changed")
    return joined.withColumn("binding", status).drop("_hex", "_size", "_seen")


def collision_audit(rows: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Identities seen with more than one size: a hard violation. Rows without an identity are none."""
    return rows.dropna(subset=list(identity)).groupBy(*identity).agg(
        F.count_distinct("size").alias("sizes"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
        F.count(F.lit(1)).alias("rows"),
    ).filter(F.col("sizes") > 1)
