"""Hand-computed cases of panel features and gates."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.functions import times
from tidewright.operators import features

SCHEMA = "location_id string, event_time timestamp, temperature_c double, humidity_pct double, precipitation_mm double, pressure_hpa double, wind_speed_kmh double, wind_gust_kmh double, latitude double, longitude double, weather_code int"


def hour_rows(start: datetime, n: int, key: str = "A", shift: float = 0.0, skip: set[int] = frozenset()):
    return [(key, start + timedelta(hours=i), i + shift, 50.0 + i, float(i), 1000.0 + i, 5.0 + i, 6.0 + i, 21.0, 105.0, 61) for i in range(n) if i not in skip]


def test_values_of_one_ready_row(spark):
    out = features.build(spark.createDataFrame(hour_rows(datetime(2020, 1, 1, 23), 30), SCHEMA)).orderBy("event_time").collect()
    assert len(out) == 5
    row = out[0]
    assert row.event_time == datetime(2020, 1, 2, 23)
    assert (row.temp_lag_1h, row.temp_lag_24h, row.temp_delta_3h, row.target_1h) == (23.0, 0.0, 3.0, 25.0)
    assert row.temp_roll_mean_3h == 23.0
    assert row.temp_roll_std_3h == pytest.approx(math.sqrt(2 / 3))
    assert row.precipitation_sum_24h == sum(range(1, 25))
    assert row.split == "TRAIN"
    names = [c for c in out[0].asDict() if c not in ("location_id", "event_time", "target_time", "weather_code", "target_1h", "split")]
    assert len(names) == 73


def test_label_stays_within_its_key(spark):
    rows = hour_rows(datetime(2020, 1, 1), 26) + hour_rows(datetime(2020, 1, 1), 26, "B", 100.0)
    out = {r.location_id: r.target_1h for r in features.build(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {"A": 25.0, "B": 125.0}


def test_gap_closes_the_gates(spark):
    df = spark.createDataFrame(hour_rows(datetime(2020, 1, 1), 32, skip={26}), SCHEMA)
    assert [r.event_time.hour for r in features.build(df).orderBy("event_time").collect()] == [0]
    assert features.gap_edges(df).first().gap_edges == 1
    island = features.gap_islands(df, "location_id", "event_time").collect()
    assert [(r.gap_start, r.gap_end, r.gap_hours) for r in island] == [(datetime(2020, 1, 2, 2), datetime(2020, 1, 2, 2), 1)]


def test_null_in_a_window_is_not_filled(spark):
    rows = hour_rows(datetime(2020, 1, 1), 30)
    rows[20] = (*rows[20][:4], None, *rows[20][5:])
    assert features.build(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_future_does_not_change_the_past(spark):
    rows = hour_rows(datetime(2020, 1, 1), 30)
    changed = rows[:28] + [(*r[:2], 999.0, *r[3:]) for r in rows[28:]]
    before, after = (features.build(spark.createDataFrame(x, SCHEMA)).filter(F.col("event_time") < datetime(2020, 1, 2, 2)).drop("target_1h").orderBy("event_time").collect() for x in (rows, changed))
    assert before and before == after


def test_splits_by_target_time(spark):
    rows = hour_rows(datetime(2023, 12, 30, 23), 27) + hour_rows(datetime(2024, 12, 30, 23), 27, "B")
    out = features.build(spark.createDataFrame(rows, SCHEMA)).groupBy("location_id").agg(F.array_sort(F.collect_set("split")).alias("s")).collect()
    assert {r.location_id: r.s for r in out} == {"A": ["VALIDATION"], "B": ["TEST"]}


def test_local_calendar_and_daylight_saving(spark):
    made = times.local_calendar(F.col("t"))
    row = spark.createDataFrame([(datetime(2020, 1, 2, 23),)], "t timestamp").select(*(v.alias(k) for k, v in made.items())).first()
    assert (row.local_hour, row.local_day_of_week) == (6, 4)
    assert row.hour_sin == pytest.approx(1.0)
    berlin = times.local_calendar(F.col("t"), "Europe/Berlin")
    both = spark.createDataFrame([(datetime(2024, 1, 1, 12),), (datetime(2024, 7, 1, 12),)], "t timestamp").select(berlin["local_hour"].alias("h")).collect()
    assert [r.h for r in both] == [13, 14]


def test_exact_future_label_takes_no_neighbour(spark):
    df = spark.createDataFrame(hour_rows(datetime(2020, 1, 1), 6, skip={3}), SCHEMA)
    out = features.future_label(df, "location_id", "event_time", "temperature_c", 2).orderBy("event_time").collect()
    assert [(r.event_time.hour, r.label) for r in out] == [(0, 2.0), (2, 4.0)]
