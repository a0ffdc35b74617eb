"""Metric records on hand-made forecasts."""

import datetime as dt
import json

from tidewright.operators.records import metric_records

SCHEMA = """reference_source string, evaluation_mode string, location_id string, target_time timestamp, status string, target_time_passed boolean,
  target_reference_received boolean, reference double, model_prediction double, persistence_prediction double, reference_arrival_lag_seconds double, evaluation_lag_seconds double"""
T = dt.datetime(2024, 5, 1, 6)


def row(place, hours, status="EVALUATED", y=10.0, m=11.0, p=13.0, lag=60.0, source="S"):
    passed = None if status == "PENDING_TARGET_TIME" else True
    return (source, None, place, T + dt.timedelta(hours=hours), status, passed, status == "EVALUATED", y, m, p, lag, 2 * lag)


def test_a_record_has_53_columns_and_its_windows_add_up(spark):
    rows = [row("a", 0), row("a", 1, y=20.0, m=19.0, p=20.5, lag=120.0), row("b", 1, status="PENDING_TARGET_TIME", y=None), row("b", 1, m=float("inf")), row(None, 1, source=None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = metric_records(df, 2, False, expected_samples=2, expected_places=2)
    assert len(out.columns) == 53
    got = {(r.reference_source, r.target_time): r for r in out.collect()}
    assert set(got) == {("S", T), ("S", T + dt.timedelta(hours=1)), ("UNKNOWN_SOURCE", T + dt.timedelta(hours=1))}
    r = got["S", T + dt.timedelta(hours=1)]
    assert (r.sample_count, r.forecasts_total, r.evaluated_count, r.pending_target_count, r.forecasts_target_time_passed) == (2, 4, 3, 1, 3)
    assert (r.model_mae, r.persistence_mae, r.model_bias) == (1.0, 1.75, 0.0)
    assert (r.locations_evaluated, r.locations_model_beats_persistence, r.location_count, r.window_complete) == (1, 1, 2, True)
    assert (r.reference_arrival_lag_median_seconds, r.evaluation_lag_max_seconds) == (90.0, 240.0)
    assert json.loads(r.distribution_json)["reference"]["mean"] == 15.0
    assert json.loads(r.metrics_json)["sample_count"] == 2
    assert len({x.metric_id for x in got.values()}) == 3


def test_places_have_records_of_their_own(spark):
    df = spark.createDataFrame([row("a", 0), row("a", 0, status="PENDING_REFERENCE", y=None), row(None, 0)], SCHEMA)
    got = {r.location_id: r for r in metric_records(df, 1, True, 1).collect()}
    assert set(got) == {"a", None}
    assert (got["a"].sample_count, got["a"].window_complete, got["a"].reference_coverage_pct) == (1, True, 50.0)
    assert got[None].quality_status == "MODEL_BEATS_PERSISTENCE"


def test_nothing_evaluated_gives_counts_alone(spark):
    one = spark.createDataFrame([row("a", 0, status="PENDING_REFERENCE", y=None, m=None, p=None)], SCHEMA)
    r = metric_records(one, 24, False, 1).first()
    assert (r.sample_count, r.model_mae, r.macro_location_mae, r.quality_status, r.distribution_json) == (0, None, None, "INSUFFICIENT_SAMPLE", "{}")
    assert metric_records(one.limit(0), 24, False, 1).isEmpty()
