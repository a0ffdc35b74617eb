"""Keyed history by hand: what a key's rows of several micro-batches become, and what timers do."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidewright.streaming import history
from tidewright.streaming.history import HOUR, KeyedHistory


class Map(dict):
    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    """State in memory, in the shape of the processor's handle."""

    def __init__(self):
        self.timers, self.map, self.value = set(), Map(), Value()

    def getMapState(self, name, key_shape, shape, live):
        return self.map

    def getValueState(self, name, shape):
        return self.value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.fixture
def key():
    made = KeyedHistory(("v",), retention_hours=10, depth=2, idle_hours=5)
    made.init(Handle())
    return made


def arrive(key, now, *rows):
    rows = [Row(second=h * HOUR, payload=p, event_id=i, offset=o, v=v) for o, (h, p, i, v) in enumerate(rows)]
    return [(r.kind, r.second // HOUR, r.outcome, r.event_id) for r in key.handleInputRows(("a",), iter(rows), TimerValues(now, -1))]


def test_a_micro_batch_is_judged_by_its_own_rows_and_the_history(key):
    assert arrive(key, 0, (1, "p", "e1", 1.0), (2, "q", None, 2.0), (2, "q", "e3", 2.0), (2, "q", "e2", 2.0), (3, "r", "x", 1.0), (3, "s", "y", 1.0)) == [
        ("REJECTED", 3, "DUPLICATE_CONFLICT", "x"), ("REJECTED", 3, "DUPLICATE_CONFLICT", "y"), ("ACCEPTED", 1, None, "e1"), ("ACCEPTED", 2, None, "e2"),
        ("STATUS", 1, "INSUFFICIENT_HISTORY", "e1"), ("STATUS", 2, "INSUFFICIENT_HISTORY", "e2"),
    ]
    assert arrive(key, 1, (1, "other", "e9", 1.0), (2, "q", "again", 2.0)) == [("REJECTED", 1, "STATE_CONFLICT", "e9")]
    assert arrive(key, 2, (4, "t", "e4", 4.0)) == [("ACCEPTED", 4, None, "e4"), ("STATUS", 4, "HISTORY_GAP", "e4")]
    late = arrive(key, 3, (3, "u", "e3", 3.0))  # fills the gap and changes what comes after
    assert late == [("ACCEPTED", 3, None, "e3"), ("STATUS", 3, "READY", "e3"), ("STATUS", 4, "READY", "e4")]


def test_what_falls_behind_the_retention_leaves_and_comes_back_as_late(key):
    arrive(key, 0, (1, "p", "e1", 1.0), (2, "p", "e2", 1.0))
    assert ("EXPIRED", 1, "RETENTION", "e1") in arrive(key, 1, (12, "p", "e12", 1.0))
    assert arrive(key, 2, (1, "p", "e1", 1.0)) == [("REJECTED", 1, "LATE_BEYOND_RETENTION", "e1")]
    assert sorted(key.rows) == [(2 * HOUR,), (12 * HOUR,)]
    assert arrive(key, 3, (40, "p", "a", 1.0), (20, "p", "b", 1.0))[-3:] == [("EXPIRED", 2, "RETENTION", "e2"), ("EXPIRED", 12, "RETENTION", "e12"), ("EXPIRED", 20, "RETENTION", "b")]


def test_values_that_are_not_finite_make_no_features(key):
    told = arrive(key, 0, (1, "p", "e1", 1.0), (2, "p", "e2", float("nan")), (3, "p", "e3", None), (4, "p", "e4", 1.0), (5, "p", "e5", 1.0), (6, "p", "e6", 1.0))
    assert [t[2] for t in told if t[0] == "STATUS"] == ["INSUFFICIENT_HISTORY"] * 2 + ["INVALID_FEATURES"] * 3 + ["READY"]


def test_timers_follow_the_last_rows_and_empty_a_silent_key(key):
    arrive(key, 1000, (1, "p", "e1", 1.0))
    arrive(key, 2000, (2, "p", "e2", 1.0))
    assert key.handle.timers == {2000 + 5 * HOUR * 1000}
    (due,) = key.handle.timers
    told = key.handleExpiredTimer(("a",), TimerValues(due + 1, -1), ExpiredTimerInfo(due))
    assert [(r.kind, r.second // HOUR, r.outcome) for r in told] == [("EXPIRED", 1, "IDLE"), ("EXPIRED", 2, "IDLE")]
    assert not key.rows and not key.alarm.exists()


def test_stored_rows_beyond_the_retention_leave_with_the_first_timer(key):
    for h in (1, 5, 15):
        key.handleInitialState(("a",), Row(second=h * HOUR, payload="p", event_id=f"e{h}", v=1.0), TimerValues(100, -1))
    assert key.handle.timers == {101}
    told = key.handleExpiredTimer(("a",), TimerValues(200, -1), ExpiredTimerInfo(101))
    assert [(r.second // HOUR, r.outcome) for r in told] == [(1, "RETENTION")]
    assert sorted(key.rows) == [(5 * HOUR,), (15 * HOUR,)]


def test_reasons_come_before_state_and_the_session_is_left_as_it_was(spark):
    rows = [("a", "2024-01-01 00:00:00", 10.0, 1.0), ("zz", "2024-01-01 00:00:00", 10.0, 1.0), ("a", None, 10.0, 1.0), ("a", "2024-01-01 00:30:00", 10.0, 1.0), ("a", "2024-01-01 00:00:00", 99.0, 1.0), ("a", "2024-01-01 00:00:00", 10.0, float("inf"))]
    df = spark.createDataFrame(rows, "location_id string, t string, latitude double, v double").select("*", F.to_timestamp("t").alias("event_time"), F.lit(100.0).alias("longitude"))
    good, bad = history.with_reason(df, spark.createDataFrame([("a",)], "location_id string"), ("v",))
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["INVALID_COORDINATE", "INVALID_EVENT_TIME", "INVALID_WEATHER_VALUE", "NON_HOURLY", "UNKNOWN_LOCATION"]
    before = [spark.conf.get(k, None) for k in (history.PROVIDER, history.EMPTY_BATCHES)]
    with history.state_store(spark, until_drained=True):
        assert spark.conf.get(history.PROVIDER) == history.ROCKS and spark.conf.get(history.EMPTY_BATCHES) == "false"
    assert [spark.conf.get(k, None) for k in (history.PROVIDER, history.EMPTY_BATCHES)] == before
