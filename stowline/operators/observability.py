"""Log and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.functions.redaction import redact_map, redact_value
from stowline.functions.units import MIB
from stowline.scale import BROADCAST_ROWS, ROWS_PER_BUCKET, lookup_join, skew_join
from stowline.session import cut_lineage

DAYS_KEPT = 7
PATH_LEVELS = ("DEBUG", "TRACE")


def redact(logs: DataFrame, fields: str = "fields", message: str | None = "msg") -> DataFrame:
    """Mask secrets in the free fields, and bearer credentials in the message."""
    out = logs.withColumn(fields, redact_map(F.col(fields)))
    if message and message in logs.columns:
        out = out.withColumn(message, redact_value(F.lit("msg"), F.col(message)))
    if "corrupt_line" in logs.columns:
        out = out.withColumn("corrupt_line", F.when(F.col("corrupt_line").isNotNull(), F.lit("[UNPARSED]")))
    return out


def metric_rollup(events: DataFrame) -> DataFrame:
    """Counters summed, gauges at their latest value (ties by the larger one). Works on streams too.

    ``events`` holds (name, kind, value, ts).
    """
    return events.groupBy("name", "kind").agg(
        F.sum("value").alias("_sum"), F.max_by("value", F.struct("ts", "value")).alias("_last"),
    ).select("name", "kind", F.when(F.col("kind") == "counter", F.col("_sum")).otherwise(F.col("_last")).alias("value"))


def prometheus_text(rollup: DataFrame, prefix: str = "stowline_") -> DataFrame:
    """Exposition lines in order: counters, then gauges, each by name; ``pos`` carries the order.

    One row per metric name comes in, so the ordering is over a bounded table.
    """
    safe = F.concat(F.lit(prefix), F.regexp_replace("name", "[^A-Za-z0-9]", "_"))
    section = F.when(F.col("kind") == "counter", F.lit("0")).otherwise(F.lit("1"))
    shown = F.when(F.col("value") == F.floor("value"), F.col("value").cast("decimal(38,0)").cast("string")).otherwise(
        F.col("value").cast("string"))
    lines = F.array(
        F.struct(F.lit("0").alias("n"), F.concat_ws(" ", F.lit("# TYPE"), safe, F.col("kind")).alias("line")),
        F.struct(F.lit("1").alias("n"), F.concat_ws(" ", safe, shown).alias("line")))
    rows = rollup.filter(F.col("kind").isin("counter", "gauge")).select(section.alias("s"), "name", F.explode(lines).alias("l"))
    return rows.select(F.struct("s", "name", "l.n").alias("pos"), F.col("l.line").alias("line"))


def retain_logs(logs: DataFrame, days: int = DAYS_KEPT) -> DataFrame:
    """Mark rows of the newest ``days`` log days, and those without a time, as kept and the rest as expired.

    The distinct days are a handful of rows; the log itself is not sorted.
    """
    dated = logs.withColumn("log_day", F.to_date("ts"))
    kept = dated.select("log_day").filter(F.col("log_day").isNotNull()).distinct().orderBy(F.desc("log_day")).limit(days)
    return lookup_join(dated, kept.withColumn("_kept", F.lit(True)), ["log_day"], "left").withColumn(
        "kept", F.coalesce("_kept", F.col("log_day").isNull())).drop("_kept")


def standard_metrics(files: DataFrame, ops: DataFrame, journal: DataFrame, capacity: DataFrame, plans: DataFrame,
                     hash_seconds: float | None = None) -> DataFrame:
    """The ``index``, ``plan``, ``apply`` and ``space`` metrics as (name, kind, value) rows.

    ``files`` carry size and is_hashed; ``ops`` are one row per operation with its lowest residual_during; ``plans`` carry
    status; ``journal`` the latest state per op with size and verify_failed; ``capacity`` free_bytes, usable and drifted.
    ``hash_seconds``, the measured time of the run, adds ``index.hash_mib_s``.
    """
    zero = F.lit(0)

    def total(column):
        return F.coalesce(F.sum(column), zero).cast("double")

    index = files.agg(
        F.count(F.lit(1)).cast("double").alias("index.files_seen"),
        F.count_if("is_hashed").cast("double").alias("index.files_hashed"),
        total(F.when(F.col("is_hashed"), F.col("size"))).alias("index.bytes_hashed"))
    plan = ops.agg(F.count(F.lit(1)).cast("double").alias("plan.ops"),
                   F.min("residual_during").cast("double").alias("plan.min_residual"))
    apply = journal.agg(
        total(F.when(F.col("state") == "Committed", F.col("size"))).alias("apply.bytes_copied"),
        F.count_if(F.col("state") == "Committed").cast("double").alias("apply.ops_committed"),
        F.count_if("verify_failed").cast("double").alias("apply.verify_failures"))
    space = capacity.agg(total("free_bytes").alias("space.free"), total("usable").alias("space.usable"),
                         F.count_if("drifted").cast("double").alias("space.drift_events"))
    stuck = plans.agg(F.count_if(F.col("status") == "unsatisfiable").cast("double").alias("plan.unsatisfiable"))
    gauges = {"plan.min_residual", "space.free", "space.usable"}
    out = None
    for table in (index, plan, stuck, apply, space):
        entries = [F.struct(F.lit(c).alias("name"), F.lit("gauge" if c in gauges else "counter").alias("kind"),
                            F.col(f"`{c}`").alias("value")) for c in table.columns]
        rows = table.select(F.explode(F.array(*entries)).alias("m")).select("m.*")
        out = rows if out is None else out.unionByName(rows)
    return out if hash_seconds is None else out.unionByName(hash_rate(out, hash_seconds))


def hash_rate(metrics: DataFrame, seconds: float) -> DataFrame:
    """``index.hash_mib_s`` from the hashed bytes and the measured run time."""
    return metrics.filter(F.col("name") == "index.bytes_hashed").select(
        F.lit("index.hash_mib_s").alias("name"), F.lit("gauge").alias("kind"),
        (F.col("value") / F.lit(float(MIB)) / F.lit(seconds)).alias("value"))


def catalog_digest(files: DataFrame) -> DataFrame:
    """Counts and bytes by library, location and collection with subtotals; holds no path or name."""
    return files.rollup("library_id", "location_id", "collection").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


GRAM_LEVELS = (4, 8, 16, 32, 64, 128)


def _edge_grams(texts: DataFrame, text: str, sizes: Column) -> DataFrame:
    """``texts`` without the text, one row per row and ``gram``: a substring of one of the given sizes that begins at a separator."""
    # The parts are a column of their own: inside the lambda below they would be split anew for each of them.
    parts = F.filter(F.split(text, r"(?=[/\\])"), lambda x: x.rlike(r"^[/\\]"))
    cut = texts.withColumn("_parts", parts).withColumn("_sizes", sizes).filter((F.size("_parts") > 0) & (F.size("_sizes") > 0)).drop(text)
    cut = cut.withColumn("_most", F.array_max("_sizes"))

    def from_part(i: Column) -> Column:
        ahead = F.substring(F.array_join(F.slice("_parts", i, F.col("_most")), ""), F.lit(1), F.col("_most"))
        return F.filter(F.transform("_sizes", lambda n: F.when(F.length(ahead) >= n, F.substring(ahead, F.lit(1), n))), lambda g: g.isNotNull())

    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_parts")), from_part))
    return cut.select(*[c for c in texts.columns if c != text], F.explode(F.array_distinct(grams)).alias("gram"))


def path_anchors(paths: DataFrame) -> DataFrame:
    """(gram, path): for each path the substring from a separator on that is in the fewest paths, as its anchor.

    Candidates have a size of ``GRAM_LEVELS`` or reach the last whole four characters, from every separator of the path, so a
    prefix or a name that many paths share is passed over. A path without four characters from a separator has none.
    """
    at = F.filter(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring("path", i, F.lit(1)).isin("/", "\\"))
    tails = F.filter(F.transform(at, lambda i: F.floor((F.length("path") - i + 1) / 4).cast("int") * 4), lambda n: n > 0)
    sizes = F.array_distinct(F.concat(F.array(*[F.lit(n) for n in GRAM_LEVELS]), tails))
    once = paths.select("path").distinct().withColumn("_text", F.col("path"))
    grams = cut_lineage(_edge_grams(once, "_text", sizes))
    spread = cut_lineage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")))
    hot = spread.filter(F.col("_n") > ROWS_PER_BUCKET).select("gram").limit(BROADCAST_ROWS)
    counted = skew_join(grams, spread, ["gram"], "inner", None if hot.isEmpty() else hot, None)
    return counted.groupBy("path").agg(F.min_by("gram", F.struct("_n", F.length("gram"), "gram")).alias("gram"))


def _meet(big: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of two stored tables: ``few`` by broadcast while it is small; else a plain one, whose hot keys adaptive
    execution splits, as no aggregate stands before it."""
    small = few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(few) if small else few, on)


def path_leak_audit(logs: DataFrame, files: DataFrame) -> DataFrame:
    """(log_id, level, field, path): catalogued paths that stand anywhere in the message or a field value of log rows above
    debug level, one row for each; ``log_id`` is unique, the message is the field ``msg``.

    Each path has one anchor (see :func:`path_anchors`); the substrings of the texts that begin at separators meet the anchors
    by equality, and what meets is held against the whole path. A path without an anchor counts only as a whole value.
    A text is never compared with all paths; ids and hashes of substrings are shuffled, and the texts once at most.
    """
    loud = logs.filter(~F.upper(F.coalesce("level", F.lit("INFO"))).isin(*PATH_LEVELS))
    told = []
    if "fields" in logs.columns:
        told.append(F.coalesce(F.map_entries("fields"), F.array().cast("array<struct<key:string,value:string>>")))
    if "msg" in logs.columns:
        told.append(F.array(F.struct(F.lit("msg").alias("key"), F.col("msg").alias("value"))))
    each = F.concat(*told)
    values = cut_lineage(loud.select("log_id", "level", F.explode(each).alias("v")).select(
        "log_id", "level", F.col("v.key").alias("field"), F.col("v.value").alias("value")).filter(F.col("value").isNotNull()))
    known = cut_lineage(files.filter(F.col("path") != "").select("path").distinct())
    anchors = cut_lineage(path_anchors(known))
    bare = cut_lineage(known.join(anchors, ["path"], "left_anti"))
    whole = lookup_join(values.withColumnRenamed("value", "path"), bare, ["path"], "left_semi")
    sizes = sorted(r.n for r in anchors.select(F.length("gram").alias("n")).distinct().collect())
    if not sizes:
        return whole.select("log_id", "level", "field", "path")
    grams = _edge_grams(values.select("log_id", "field", "value"), "value", F.array(*[F.lit(n) for n in sizes]))
    # By hash: a collision only adds a pair, and every pair is held against its text below.
    hashed = anchors.select(F.xxhash64("gram").alias("_h"), "path")
    hits = _meet(grams.select("log_id", "field", F.xxhash64("gram").alias("_h")), hashed, ["_h"])
    pairs = cut_lineage(hits.select("log_id", "field", "path").distinct())
    inside = _meet(values, pairs, ["log_id", "field"]).filter(F.contains("value", "path"))
    return whole.select("log_id", "level", "field", "path").unionByName(inside.select("log_id", "level", "field", "path"))
