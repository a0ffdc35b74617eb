"""Bounded history of each key inside a stream (CMP-05, STR-09/10/11), by Spark's arbitrary state.

``operators.state.run_batch`` joins a micro-batch to a stored table, which its caller merges.  Here the history is the
stream's own state: a map of a key's hours, checkpointed with the stream, so a restart goes on where it stopped and no
table is merged.  A key's rows of a micro-batch are judged against its history, the hours they change get a status, and
what falls behind the retention leaves the state and is told.  Timers empty keys that have gone silent; a time to live
on the map's entries is the backstop.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.joins import member_flag
from ..operators.quality import reject_reason

HOUR = 3600
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER, EMPTY_BATCHES = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"


class KeyedHistory(StatefulProcessor):
    """Rows (second, payload, event_id, offset, values) of a key in; rows (kind, second, outcome, event_id, values) out.

    Of a micro-batch: an hour with several payloads rejects all its rows (DUPLICATE_CONFLICT), of equal rows the first by
    event id (null last) and offset speaks; a stored hour with another payload rejects (STATE_CONFLICT), with the same one
    is silent; an hour more than the retention before the latest stored rejects (LATE_BEYOND_RETENTION); others are
    ACCEPTED.  Each stored hour from an accepted one to ``depth`` hours later gets a STATUS.  EXPIRED hours leave.
    """

    def __init__(self, values: tuple[str, ...], retention_hours: int, depth: int, idle_hours: int | None):
        self.values, self.retention, self.depth = values, retention_hours * HOUR, depth
        self.idle_ms = idle_hours * HOUR * 1000 if idle_hours else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        shape = "payload string, event_id string" + "".join(f", `{v}` double" for v in self.values)
        live = 2 * self.idle_ms + self.retention * 1000 if self.idle_ms else None
        self.rows = handle.getMapState("rows", "second long", shape, live)
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInitialState(self, key, initialState: Row, timerValues: TimerValues) -> None:
        """A stored row; what of it is beyond the retention leaves with the first timer, after the key's own rows."""
        r = initialState
        self.rows.updateValue((r.second,), (r.payload, r.event_id, *(r[v] for v in self.values)))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        arrived: dict[int, tuple[list[Row], set[str], list[str]]] = {}
        for r in rows:
            first, payloads, ids = arrived.setdefault(r.second, ([r], set(), []))
            payloads.add(r.payload)
            ids.append(r.event_id)
            if self._order(r) < self._order(first[0]):
                first[0] = r
        stored = {k[0]: v for k, v in self.rows.iterator()}
        latest, accepted = max(stored, default=None), []
        for second, ([r], payloads, ids) in sorted(arrived.items()):
            if len(payloads) > 1:
                yield from (self._told(key, "REJECTED", second, "DUPLICATE_CONFLICT", i) for i in ids)
            elif second in stored:
                if stored[second][0] != r.payload:
                    yield self._told(key, "REJECTED", second, "STATE_CONFLICT", r.event_id)
            elif latest is not None and second < latest - self.retention:
                yield self._told(key, "REJECTED", second, "LATE_BEYOND_RETENTION", r.event_id)
            else:
                accepted.append((second, (r.payload, r.event_id, *(r[v] for v in self.values))))
        for second, kept in accepted:
            self.rows.updateValue((second,), kept)
            stored[second] = kept
            yield self._told(key, "ACCEPTED", second, None, kept[1], kept[2:])
        yield from self._statuses(key, stored, [second for second, _ in accepted])
        yield from self._evicted(key, stored)
        if self.idle_ms:
            if self.alarm.exists():
                self.handle.deleteTimer(self.alarm.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        stored = {k[0]: v for k, v in self.rows.iterator()}
        if self.alarm.exists() and self.alarm.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            yield from (self._told(key, "EXPIRED", second, "IDLE", stored[second][1]) for second in sorted(stored))
            self.rows.clear()
            self.alarm.clear()
        else:
            yield from self._evicted(key, stored)

    @staticmethod
    def _order(r: Row) -> tuple:
        return r.event_id is None, r.event_id or "", r.offset

    def _told(self, key, kind: str, second: int, outcome: str | None, event_id: str | None, values: tuple = ()) -> Row:
        return Row(kind=kind, key=key[0], second=second, outcome=outcome, event_id=event_id, **dict(zip(self.values, values or [None] * len(self.values))))

    def _statuses(self, key, stored: dict, changed: list[int]) -> Iterator[Row]:
        times, reach, done = sorted(stored), self.depth * HOUR, -1
        for second in changed:  # ascending
            for at in range(max(done + 1, bisect_left(times, second)), bisect_right(times, second + reach)):
                done = at
                before = times[bisect_left(times, times[at] - reach) : at + 1]
                if at < self.depth:
                    outcome = "INSUFFICIENT_HISTORY"
                elif len(before) <= self.depth:
                    outcome = "HISTORY_GAP"
                elif not all(x is not None and math.isfinite(x) for t in before for x in stored[t][2:]):
                    outcome = "INVALID_FEATURES"
                else:
                    outcome = "READY"
                yield self._told(key, "STATUS", times[at], outcome, stored[times[at]][1], stored[times[at]][2:])

    def _evicted(self, key, stored: dict) -> Iterator[Row]:
        for second in sorted(s for s in stored if s < max(stored) - self.retention):
            self.rows.removeKey((second,))
            yield self._told(key, "EXPIRED", second, "RETENTION", stored[second][1])


def _shaped(df: DataFrame, key: str, time: str, payload: str, values: tuple[str, ...], *more: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.unix_seconds(time).alias("second"), F.col(payload).alias("payload"), "event_id", *more, *(F.col(v).cast("double").alias(v) for v in values))


def keyed_history(
    stream: DataFrame, values: tuple[str, ...], stored: DataFrame | None = None, key: str = "location_id", time: str = "event_time", payload: str = "payload_hash",
    retention_hours: int = 48, depth: int = 24, idle_hours: int | None = 24 * 30,
) -> DataFrame:
    """kind, key, second, outcome, event_id and values of what ``KeyedHistory`` tells of a stream (append mode).

    ``stream`` has event_id, offset, key, time, payload and values, none of key, time and payload null; ``stored`` the same
    without offset: the history that the first micro-batch of a new checkpoint starts from.  State is bounded by keys times
    retention; a micro-batch's rows of a key are held by hour (equal ones once), so bound micro-batches at the source.
    """
    name = stream.schema[key].dataType.simpleString()
    out = f"kind string, key {name}, second long, outcome string, event_id string" + "".join(f", `{v}` double" for v in values)
    start = _shaped(stored, key, time, payload, values).groupBy("key") if stored is not None else None
    rows = _shaped(stream, key, time, payload, values, "offset").groupBy("key")
    return rows.transformWithState(KeyedHistory(values, retention_hours, depth, idle_hours), out, "Append", "ProcessingTime", start)


def with_reason(stream: DataFrame, known: DataFrame, values: tuple[str, ...], key: str = "location_id", time: str = "event_time") -> tuple[DataFrame, DataFrame]:
    """(sound rows, rows with the first ``reason`` to reject them), both before any state; ``known`` lists the keys."""
    flagged = member_flag(stream, known, [key], "_known").withColumn("reason", reject_reason(F.col("_known"), time, values=values)).drop("_known")
    return flagged.filter("reason is null").drop("reason"), flagged.filter("reason is not null")


@contextmanager
def state_store(spark: SparkSession, until_drained: bool = False) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which arbitrary state needs; the session is as before afterwards.

    ``until_drained``: no micro-batch runs for timers alone, without which a run of all that is there would never end;
    due timers then wait for the next rows.
    """
    wanted = {PROVIDER: ROCKS} | ({EMPTY_BATCHES: "false"} if until_drained else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
