"""Audit of journal transitions as a stream, with state that ends."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stowline.operators.journal import EDGES, STATES, TERMINAL
from stowline.streaming.tables import append_batches

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "10 minutes"
GRACE_MS = 24 * 3600 * 1000
OUT = "library_id BIGINT, op_id BIGINT, event_id BIGINT, from_state STRING, to_state STRING"
ALLOWED = frozenset(EDGES) | {(s, "NeedsAttention") for s in STATES if s not in TERMINAL}


class TransitionAudit(StatefulProcessor):
    """Per op: the last audited state, and the transitions that the watermark has not passed yet.

    Arrivals wait, in any order, until the watermark passes their time; a timer then audits them by (time, event id), so late
    rows within the watermark's delay give what a sorted table gives. An op that has reached a final state keeps its last
    state for ``grace_ms`` of event time, in which a further transition is still told as illegal, and then leaves the store.
    """

    def __init__(self, grace_ms: int = GRACE_MS) -> None:
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state STRING, ms BIGINT")
        self.waiting = handle.getListState("waiting", "us BIGINT, event_id BIGINT, state STRING")
        self.due = handle.getValueState("due", "ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(r.us, r.event_id, r.state) for r in rows]
        self.waiting.appendList(fresh)
        self._wake(min(us for us, _, _ in fresh) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in held if r[0] // 1000 <= now]
        later = held[len(ready):]
        state, ms = tuple(self.last.get()) if self.last.exists() else ("NotStarted", None)
        for us, event_id, to in ready:
            if to != state and (state, to) not in ALLOWED:
                yield Row(library_id=key[0], op_id=key[1], event_id=event_id, from_state=state, to_state=to)
            state, ms = to, us // 1000
        if later:
            self.waiting.put(later)
        elif held:
            self.waiting.clear()
        over = state in TERMINAL and not later and ms is not None
        if over and now >= ms + self.grace_ms:
            self.last.clear()
            return
        if ms is not None:
            self.last.update((state, ms))
        if later:
            self._wake(later[0][0] // 1000)
        elif over:
            self._wake(ms + self.grace_ms)

    def _wake(self, ms: int) -> None:
        """One timer an op: the earliest asked for."""
        if self.due.exists():
            due = self.due.get()[0]
            if due <= ms:
                return
            self.handle.deleteTimer(due)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def close(self) -> None:
        pass


def audited(transitions: DataFrame, lateness: str = LATENESS, grace_ms: int = GRACE_MS) -> DataFrame:
    """Illegal transitions (library_id, op_id, event_id, from_state, to_state) of a stream of (library_id, op_id, event_id,
    state, updated_at), each told once the watermark, ``lateness`` behind the newest time, has passed it.

    Equals ``transition_audit`` over the same rows as long as none is later than ``lateness`` (Spark drops those) and none
    follows a final state by more than ``grace_ms``. Rows without a key, a state or a time take no part. Needs the RocksDB
    state store.
    """
    timed = transitions.filter("library_id IS NOT NULL AND op_id IS NOT NULL AND state IS NOT NULL AND updated_at IS NOT NULL").select(
        F.col("library_id").cast("bigint").alias("library_id"), F.col("op_id").cast("bigint").alias("op_id"),
        F.col("event_id").cast("bigint").alias("event_id"), "state", F.col("updated_at").cast("timestamp").alias("updated_at"))
    stamped = timed.withColumn("us", F.unix_micros("updated_at")).withWatermark("updated_at", lateness)
    return stamped.groupBy("library_id", "op_id").transformWithState(
        statefulProcessor=TransitionAudit(grace_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def stream_transitions(transitions: DataFrame, folder: str, checkpoint: str, lateness: str = LATENESS, grace_ms: int = GRACE_MS) -> StreamingQuery:
    """Store the illegal transitions of a stream, one folder per micro-batch, replaced when the batch is replayed.

    A query keeps the state store that the session names when it starts; only this one gets RocksDB.
    """
    conf = transitions.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return append_batches(audited(transitions, lateness, grace_ms), folder, checkpoint)
    finally:
        conf.set(PROVIDER, before)
