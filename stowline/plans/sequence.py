"""Order the placements so that every prefix keeps the reserve and the last copy.

Each class of operation draws on one resource only, the free bytes of its dest, so a class is decided for all dests of
all libraries at once: "largest that still fits" is one pass over the rows of a dest in order, or waves where a dest has
too many for one task. Classes run in the order upload+evict, evict, upload, shuttle, evict, download, evict; rounds
repeat while anything is admitted.

The loop keeps a ledger: the rows still open, one running balance per location, one count of copies per blob that may lose
one, and the admitted rows, which are appended and not read again before the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.operators.capacity import DEFAULT_RESERVE, staging_candidates
from stowline.operators.dups import usable_verified
from stowline.operators.identity import BLOB_KEY
from stowline.scale import ROWS_PER_BUCKET, hot_keys, lookup_join, order_buckets, rank_in, running_sum, skew_join
from stowline.session import cut_lineage, new_folder

RESOURCE = ["library_id", "dest"]
CLASSES = ("upload_evict", "upload_keep", "shuttle", "download")
NO_HINT = 1 << 30

# Step numbers inside a round; they order the plan.
UPLOAD_EVICT, EVICT_1, UPLOAD_KEEP, SHUTTLE, EVICT_2, DOWNLOAD, EVICT_3 = range(1, 8)


@dataclass
class Sequenced:
    """Ordered operations, and the needs and evicts that found no place."""

    ops: DataFrame
    leftover: DataFrame
    dropped: DataFrame
    balance: DataFrame


def admit_largest(rows: DataFrame, buckets: list[str], eligible: str, limit: str) -> DataFrame:
    """Mark in ``admitted`` the rows that "largest that still fits" takes from each dest's ``limit``.

    ``rows`` holds library_id, blob_id, dest and size, plus a Boolean ``eligible`` column; ``limit`` is
    constant per dest. Without buckets the rows of a dest pass one task in order, which keeps nothing but what is left.
    With buckets (a dest beyond one task) waves do the same: sum the rows that fit alone, largest first, admit those whose
    running sum fits, subtract, repeat. A wave leaves less than the first row it refused, so waves are few.
    """
    order = [F.col("size").desc(), F.col("blob_id"), F.col("dest")]
    if not buckets:
        return _admit_in_order(rows, order, eligible, limit)
    zero = F.lit(0).cast("long")
    state = rows.withColumns({"admitted": F.lit(False), "_left": F.col(limit)})
    while True:
        fits = F.col(eligible) & ~F.col("admitted") & (F.col("size") <= F.col("_left"))
        state = cut_lineage(running_sum(state, RESOURCE, order, F.when(fits, F.col("size")).otherwise(zero), "_run", buckets))
        taken = fits & (F.col("_run") <= F.col("_left"))
        used = state.groupBy(*RESOURCE).agg(F.sum(F.when(taken, F.col("size")).otherwise(zero)).alias("_used"))
        state = lookup_join(state, used, RESOURCE, "inner")
        state = cut_lineage(state.withColumns({"admitted": F.col("admitted") | taken, "_left": F.col("_left") - F.col("_used")}).drop(
            "_run", "_used"))
        more = state.filter(F.col(eligible) & ~F.col("admitted") & (F.col("size") <= F.col("_left")))
        if more.isEmpty():
            return state.drop("_left")


def _admit_in_order(rows: DataFrame, order: list, eligible: str, limit: str) -> DataFrame:
    # Rows that are out, or don't fit into all there is, need no order.
    hopeful = F.coalesce(F.col(eligible), F.lit(False)) & F.coalesce(F.col("size") <= F.col(limit), F.lit(False))
    out = rows.filter(~hopeful).withColumn("admitted", F.lit(False))
    names = rows.columns
    keys = [names.index(c) for c in (*RESOURCE, "size", limit)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, 0
        for batch in batches:
            libraries, dests, sizes, limits = (batch.column(k).to_pylist() for k in keys)
            taken = []
            for library, dest, size, most in zip(libraries, dests, sizes, limits):
                if (library, dest) != now:
                    now, left = (library, dest), most
                fits = size <= left
                left -= size if fits else 0
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], [*names, "admitted"])

    schema = ", ".join([*[f"`{n}` {k}" for n, k in rows.dtypes], "admitted boolean"])
    placed = rows.filter(hopeful).repartition(*RESOURCE).sortWithinPartitions(*RESOURCE, *order).mapInArrow(run, schema)
    return out.unionByName(placed)


class Sequencer:
    """Loop state of :func:`sequence`."""

    def __init__(self, needs: DataFrame, evicts: DataFrame, replicas: DataFrame, locations: DataFrame, reserve: int,
                 rows_per_bucket: int) -> None:
        self.reserve = reserve
        self.rows_per_bucket = rows_per_bucket
        self.place_type = dict(locations.dtypes)["location_id"]
        null = F.lit(None)
        ready = needs.withColumns({
            "soft": (F.col("keep_local") == "prefer") & (F.col("dest_kind") == "volume"), "staging": null.cast(self.place_type)})
        ready, self.need_buckets = order_buckets(
            ready, RESOURCE, "size", "blob_id", descending=True, rows_per_bucket=rows_per_bucket)
        ready = self._store(ready, "op_class")
        self.open = {kind: ready.filter(F.col("op_class") == kind) for kind in CLASSES}
        self.pending = {r["op_class"]: r["n"] for r in ready.groupBy("op_class").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.empty = ready.limit(0)
        self.done: list[DataFrame] = []
        self.fresh: list[DataFrame] = []
        self.given_up: list[DataFrame] = []
        hint = F.col("hint") if "hint" in evicts.columns else F.lit(None)
        spare = evicts.select(*BLOB_KEY, "file_id", "location_id", "size", "min_replicas", "n_goals",
                              F.coalesce(hint.cast("int"), F.lit(NO_HINT)).alias("hint"))
        spare, self.evict_buckets = order_buckets(spare, BLOB_KEY, "hint", "file_id", rows_per_bucket=rows_per_bucket)
        self.spare = cut_lineage(spare)
        self.gone: list[DataFrame] = []
        self.hot_blobs = hot_keys(self.spare, BLOB_KEY, rows_per_bucket) if self.evict_buckets else None
        touched = self.spare.select(*BLOB_KEY).distinct()
        counts = replicas.filter(usable_verified()).groupBy(*BLOB_KEY).agg(F.count(F.lit(1)).alias("have"))
        zero = F.lit(0).cast("long")
        self.copies = cut_lineage(touched.join(counts, BLOB_KEY, "left").select(
            *BLOB_KEY, F.coalesce("have", zero).alias("have"), zero.alias("unmet"), null.cast(self.place_type).alias("pair")))
        floor = F.when(F.col("kind") == "volume", F.lit(reserve)).otherwise(F.lit(0)).cast("long")
        self.balance = cut_lineage(locations.withColumn("usable", F.col("free_bytes") - floor))

    @staticmethod
    def _store(rows: DataFrame, split: str) -> DataFrame:
        """The rows as a stored table with a folder for each value of ``split``, so that readers of one skip the others."""
        folder = new_folder(rows.sparkSession, "state")
        rows.write.partitionBy(split).parquet(folder)
        return rows.sparkSession.read.schema(rows.schema).parquet(folder)

    def _settle(self, moved: DataFrame) -> int:
        """Add (library_id, location_id, d) to the balances; returns how many rows there were."""
        delta = moved.groupBy("library_id", "location_id").agg(F.sum("d").alias("_d"), F.count(F.lit(1)).alias("_n"))
        zero = F.lit(0).cast("long")
        now = self.balance.drop("_n").join(delta, ["library_id", "location_id"], "left")
        d = F.coalesce("_d", zero)
        self.balance = cut_lineage(now.withColumns({
            "free_bytes": F.col("free_bytes") + d, "usable": F.col("usable") + d, "_n": F.coalesce("_n", zero)}).drop("_d"))
        return self.balance.agg(F.sum("_n")).first()[0] or 0

    def transfer(self, kind: str, round_no: int, step: int) -> int:
        """Admit what fits of one class; returns how many rows were admitted."""
        if not self.pending.get(kind):
            return 0
        room = self.balance.select("library_id", F.col("location_id").alias("dest"), F.col("usable").alias("_limit"))
        rows = lookup_join(self.open[kind], room, RESOURCE, "left").withColumn("_limit", F.coalesce("_limit", F.lit(-1).cast("long")))
        is_open = F.lit(True)
        if kind == "shuttle":
            hop = lookup_join(rows, staging_candidates(self.balance.drop("_n")), ["library_id"], "left")
            pick = F.when(F.col("shuttle.usable") >= F.col("size"), F.col("shuttle.location_id")).when(
                F.col("other.usable") >= F.col("size"), F.col("other.location_id"))
            rows = hop.withColumn("staging", pick).drop("shuttle", "other")
            is_open = F.col("staging").isNotNull()
        marked = self._store(admit_largest(rows.withColumn("_open", is_open), self.need_buckets, "_open", "_limit").drop("_open", "_limit"), "admitted")
        part = marked.filter("admitted").drop("admitted").withColumns({"round": F.lit(round_no), "step": F.lit(step)})
        n = self._settle(part.select("library_id", F.col("dest").alias("location_id"), (-F.col("size")).alias("d")))
        self.open[kind] = marked.filter("NOT admitted").drop("admitted")
        if n:
            self.done.append(part)
            self.fresh.append(part)
        self.pending[kind] -= n
        return n

    def evict(self, round_no: int, step: int) -> int:
        """Admit evicts while every blob keeps ``max(1, effective minimum)`` verified copies.

        Candidates are numbered per blob, hinted volumes first, so two copies never count on each other. A copy
        that a pending placement still reads from is held back.
        """
        reading = self._all(self.open.values()).filter(F.col("src_kind") == "volume").select(
            "library_id", F.col("src_file_id").alias("file_id")).distinct().withColumn("_read", F.lit(True))
        if self.fresh:
            paired = F.max(F.when((F.col("round") == round_no) & (F.col("step") == UPLOAD_EVICT), F.col("dest")))
            gained = self._all(self.fresh).groupBy(*BLOB_KEY).agg(F.count(F.lit(1)).alias("_gain"), paired.alias("_pair"))
            self.copies = cut_lineage(self.copies.join(gained, BLOB_KEY, "left").select(
                *BLOB_KEY, (F.col("have") + F.coalesce("_gain", F.lit(0).cast("long"))).alias("have"), "unmet", F.col("_pair").alias("pair")))
            self.fresh = []
        rows = skew_join(self.spare, self.copies, BLOB_KEY, "left", self.hot_blobs, None)
        rows = rows.join(reading, ["library_id", "file_id"], "left")
        least = F.greatest(F.lit(1), F.least("min_replicas", F.col("n_goals") - F.col("unmet")))
        rows = rows.withColumns({"_least": least, "_open": F.col("_read").isNull()})
        rows = running_sum(rows, BLOB_KEY, [F.col("hint"), F.col("file_id")], F.col("_open").cast("long"), "_no", self.evict_buckets)
        taken = F.col("_open") & (F.col("have") - F.col("_no") >= F.col("_least"))
        paired = (F.col("_no") == 1) & F.col("pair").isNotNull() & F.lit(step == EVICT_1)
        marked = self._store(rows.select(*self.spare.columns, F.when(paired, F.col("pair")).alias("pair_dest"), taken.alias("taken")), "taken")
        part = marked.filter("taken").drop("taken").withColumns({
            "round": F.lit(round_no), "step": F.when(F.col("pair_dest").isNotNull(), F.lit(UPLOAD_EVICT)).otherwise(F.lit(step))})
        n = self._settle(part.select("library_id", "location_id", F.col("size").alias("d")))
        self.spare = marked.filter("NOT taken").drop("taken", "pair_dest")
        if n:
            self.gone.append(part)
            lost = part.groupBy(*BLOB_KEY).agg(F.count(F.lit(1)).alias("_loss"))
            self.copies = cut_lineage(self.copies.join(lost, BLOB_KEY, "left").withColumn(
                "have", F.col("have") - F.coalesce("_loss", F.lit(0).cast("long"))).drop("_loss"))
        return n

    def _all(self, frames) -> DataFrame:
        out = None
        for frame in frames:
            out = frame if out is None else out.unionByName(frame)
        return self.empty if out is None else out

    def drop_soft(self) -> int:
        """Give up preferred local copies that do not fit; returns how many."""
        frame = self.open["download"]
        part = frame.filter("soft")
        n = part.count() if self.pending.get("download") else 0
        if n:
            self.given_up.append(part)
            self.open["download"] = frame.filter("NOT soft")
            self.pending["download"] -= n
            unmet = part.groupBy(*BLOB_KEY).agg(F.count(F.lit(1)).alias("_drop"))
            self.copies = cut_lineage(self.copies.join(unmet, BLOB_KEY, "left").withColumn(
                "unmet", F.col("unmet") + F.coalesce("_drop", F.lit(0).cast("long"))).drop("_drop"))
        return n

    def run(self) -> None:
        """Repeat the steps until none can move: each is retried only after what it waits for has changed.

        Cloud space never grows, so an upload that did not fit at first never will, and a shuttle is
        tried again only if it lacked staging space. Shuttles and downloads wait for freed volume
        space, evicts for new verified copies or for a preferred goal that was given up.
        """
        any_evict = not self.spare.isEmpty()
        round_no, copies, space = 1, True, True
        moved = self.transfer("upload_evict", round_no, UPLOAD_EVICT)
        if any_evict and self.evict(round_no, EVICT_1):
            copies = False
        copies = self.transfer("upload_keep", round_no, UPLOAD_KEEP) > 0 or (copies and moved > 0)
        shuttle_waits = True
        while True:
            if space and shuttle_waits:
                copies = self.transfer("shuttle", round_no, SHUTTLE) > 0 or copies
                shuttle_waits = self.lacks_staging()
            if copies and any_evict:
                space = self.evict(round_no, EVICT_2) > 0 or space
            copies = False
            loaded = self.transfer("download", round_no, DOWNLOAD) if space else 0
            space = loaded > 0 and any_evict and self.evict(round_no, EVICT_3) > 0
            if not space:
                if self.drop_soft() == 0:
                    return
                copies = True
            round_no += 1

    def lacks_staging(self) -> bool:
        if not self.pending.get("shuttle"):
            return False
        return not self.open["shuttle"].filter("staging IS NULL").isEmpty()

    def operations(self) -> DataFrame:
        """All admitted rows with their position per library."""
        null = F.lit(None)
        columns = {"file_id": F.col("src_file_id"), "_at": F.col("dest"), "_sub": F.lit(0), "_hint": F.lit(NO_HINT)}
        head = [*BLOB_KEY, "file_id", "size", "src", "dest", "staging", "path", "dest_subdir", "round", "step", "kind", "_hint", "_at", "_sub"]
        moves = self._all(self.done) if self.done else self.empty.withColumns({"round": F.lit(0), "step": F.lit(0)})
        moves = moves.withColumns(columns)
        gone = self._all(self.gone) if self.gone else self.spare.withColumns(
            {"pair_dest": null.cast(self.place_type), "round": F.lit(0), "step": F.lit(0)}).limit(0)
        pairs = gone.filter(F.col("pair_dest").isNotNull()).select(*BLOB_KEY, F.col("pair_dest").alias("dest"), F.lit("upload_evict").alias("op_class"),
                                                                  F.lit(True).alias("_pair"))
        single = (F.col("op_class") == "upload_evict") & F.col("_pair").isNull()
        moves = moves.join(pairs, [*BLOB_KEY, "dest", "op_class"], "left").withColumn("kind", F.when(single, "upload_keep").otherwise(F.col("op_class")))
        types = dict(moves.dtypes)
        lost = gone.select(
            *BLOB_KEY, "file_id", "size", F.col("location_id").alias("src"), null.cast(types["dest"]).alias("dest"),
            null.cast(types["staging"]).alias("staging"), null.cast("string").alias("path"),
            null.cast("string").alias("dest_subdir"), "round", "step", F.lit("evict").alias("kind"),
            F.when(F.col("pair_dest").isNull(), F.col("hint")).otherwise(F.lit(NO_HINT)).alias("_hint"),
            F.coalesce("pair_dest", "location_id").alias("_at"), F.lit(1).alias("_sub"))
        ops = lost.select(*head).unionByName(moves.select(*head))
        ops, buckets = order_buckets(ops, ["library_id"], "size", "blob_id", descending=True,
                                     rows_per_bucket=self.rows_per_bucket)
        if buckets:
            buckets = ["round", "step", "_hint", *buckets]
        order = [F.col("round"), F.col("step"), F.col("_hint"), F.col("size").desc(), F.col("blob_id"), F.col("_at"), F.col("_sub"),
                 F.col("file_id")]
        return rank_in(ops, ["library_id"], order, "seq", buckets).drop("_hint", "_at", "_sub", "_b1", "_b2")

    def leftover(self, dropped: bool) -> DataFrame:
        frames = self.given_up if dropped else self.open.values()
        return self._all(frames).select(*BLOB_KEY, "dest", "dest_kind", "size", "op_class", "keep_local")


def sequence(needs: DataFrame, evicts: DataFrame, replicas: DataFrame, locations: DataFrame,
             reserve: int = DEFAULT_RESERVE, rows_per_bucket: int = ROWS_PER_BUCKET) -> Sequenced:
    """Order classified needs and evict candidates into a safe plan per library.

    ``needs`` come from ``classify_ops``; ``locations`` carry kind, free_bytes, is_online, is_shuttle and is_overlay. A
    ``hint`` on ``evicts`` (lowest first) says which copies go first; it never lets one go that must stay.
    """
    needs = needs if "dest_subdir" in needs.columns else needs.withColumn("dest_subdir", F.lit(None).cast("string"))
    work = Sequencer(needs, evicts, replicas, locations, reserve, rows_per_bucket)
    work.run()
    return Sequenced(cut_lineage(work.operations()), work.leftover(False), work.leftover(True), work.balance.drop("_n"))
