"""Keyed state over micro-batches: guarded note lifecycles, and values that are stashed and taken.

Both run as ``transformWithState`` processors on the RocksDB state store, so state is checkpointed with the stream and a
restarted query, or one that lost an executor, goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestack.operators.lifecycle import ALLOWED

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: An event names the status that it asks for; seq orders the events of a note.
EVENT = "note_id long, seq long, to string, summary string, at timestamp"
TRANSITION = "note_id long, seq long, before string, after string, accepted boolean, reason string, summary string"
STEP = "branch string, ord long, op string, sha string"
TAKEN = "branch string, ord long, sha string"

FIRST = "provisional"


def with_state(spark: SparkSession) -> SparkSession:
    """Set the state store that these jobs need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


class Lifecycle(StatefulProcessor):
    """The status of one note. A transition that is not allowed is answered by a rejected row and changes nothing; what is
    confirmed or superseded stays so. open_ms: a note still provisional so long after its first event is superseded by a
    timer; None: never."""

    def __init__(self, open_ms: int | None = None) -> None:
        self.open_ms = open_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status string, last_seq long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        status, last, due = self.state.get() if self.state.exists() else (FIRST, -1, None)
        for r in sorted(rows, key=lambda r: r.seq):
            before = status
            if r.seq <= last:
                reason = "replayed"
            elif r.to == before or before != FIRST:
                reason = "settled" if before != FIRST else "unchanged"
            elif (before, r.to) not in ALLOWED:
                reason = "not allowed"
            else:
                reason, status = None, r.to
            last = max(last, r.seq)
            yield Row(note_id=key[0], seq=r.seq, before=before, after=status, accepted=reason is None, reason=reason, summary=r.summary if reason is None else None)
        if self.open_ms is not None:
            if status == FIRST and due is None:
                due = timerValues.getCurrentProcessingTimeInMs() + self.open_ms
                self.handle.registerTimer(due)
            elif status != FIRST and due is not None:
                self.handle.deleteTimer(due)
                due = None
        self.state.update((status, last, due))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        status, last, _ = self.state.get()
        if status == FIRST:
            self.state.update(("superseded", last, None))
            yield Row(note_id=key[0], seq=last, before=status, after="superseded", accepted=True, reason=None, summary="left open too long")

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, open_ms: int | None = None) -> DataFrame:
    """A row for each event of a stream (note_id, seq, to, summary, at): the transition that it made, or why it was rejected
    (replayed: seen before; settled; unchanged; not allowed). Events of a note in one batch go by seq. An event without a
    note is left out."""
    with_state(events.sparkSession)
    mode = "None" if open_ms is None else "ProcessingTime"
    return events.filter("note_id is not null and seq is not null").groupBy("note_id").transformWithState(Lifecycle(open_ms), TRANSITION, "Append", mode)


def settled(transitions: DataFrame) -> DataFrame:
    """(note_id, status, summary) from the rows of ``lifecycle``, as written: the last accepted transition of each note, or
    provisional."""
    last = F.max(F.when(F.col("accepted"), F.struct("seq", "after", "summary"))).alias("t")
    return transitions.groupBy("note_id").agg(last).select("note_id", F.coalesce("t.after", F.lit(FIRST)).alias("status"), "t.summary")


class Stash(StatefulProcessor):
    """The value stashed last for one branch; a take consumes it. expiry_ms: a value not taken so long is gone."""

    def __init__(self, expiry_ms: int | None = None) -> None:
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getMapState("pending", "slot string", "sha string", ttlDurationMs=self.expiry_ms)
        self.upto = handle.getValueState("upto", "ord long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        upto = self.upto.get()[0] if self.upto.exists() else None
        slot = ("sha",)
        sha = self.pending.getValue(slot)[0] if self.pending.exists() and self.pending.containsKey(slot) else None
        stashed = sha
        for r in sorted(rows, key=lambda r: r.ord):
            if upto is not None and r.ord <= upto:
                continue  # replayed
            upto = r.ord
            if r.op == "stash":
                sha = r.sha if r.sha is not None else sha
            elif r.op == "take":
                yield Row(branch=key[0], ord=r.ord, sha=sha)
                sha = None
        if sha != stashed:
            if sha is None:
                self.pending.removeKey(slot)
            else:
                self.pending.updateValue(slot, (sha,))
        if upto is not None:
            self.upto.update((upto,))

    def close(self) -> None:
        pass


def taken(steps: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """(branch, ord, sha) of each take of a stream (branch, ord, op: stash or take, sha): the sha stashed last since the take
    before, in this batch or an earlier one, else null. Steps of a branch go by ord; a step that comes after a later one of
    its branch was answered is taken for a replay and left out."""
    with_state(steps.sparkSession)
    return steps.filter("branch is not null and ord is not null").groupBy("branch").transformWithState(Stash(expiry_ms), TAKEN, "Append", "None" if expiry_ms is None else "ProcessingTime")


def run(result: DataFrame, target: str, checkpoint: str, timed: bool = False) -> None:
    """Work off what a stream has by now, and append the result to a folder; exactly once, also over restarts. timed: the
    job has timers or an expiry, whose batches never end by themselves: one batch takes all."""
    now = {"once": True} if timed else {"availableNow": True}
    result.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(**now).start().awaitTermination()
