"""Queries: metric records of windows (CMP-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import six
from ..operators.records import metric_records
from .base import SCORED, query, s6, scored, sec, seconds

HOUR = "CAST(epoch(event_time) / 3600 AS BIGINT)"
STATUS = f"CASE WHEN {HOUR} % 11 = 0 THEN 'PENDING_REFERENCE' WHEN {HOUR} % 13 = 0 THEN 'REFERENCE_CONFLICT' ELSE 'EVALUATED' END"
RATED = f"""rated AS (SELECT CASE WHEN {HOUR} % 5 <> 0 THEN 'LIVE' ELSE 'UNKNOWN_SOURCE' END AS reference_source, 'PROSPECTIVE' AS evaluation_mode, location_id, event_time AS target_time, {STATUS} AS status,
  {HOUR} % 11 <> 0 AS received, reference, model_prediction AS m, persistence_prediction AS p, CAST({HOUR} % 7 * 60 AS DOUBLE) AS arrival, CAST({HOUR} % 3 * 30 AS DOUBLE) AS lag FROM scored)"""


def rated(spark, d):
    """Scored forecasts with a source, a status and lags by hour (see the SQL)."""
    hour = F.floor(F.unix_seconds("event_time") / 3600)
    status = F.when(hour % 11 == 0, "PENDING_REFERENCE").when(hour % 13 == 0, "REFERENCE_CONFLICT").otherwise("EVALUATED")
    return scored(spark, d).select(
        F.when(hour % 5 != 0, "LIVE").alias("reference_source"), F.lit("PROSPECTIVE").alias("evaluation_mode"), "location_id", F.col("event_time").alias("target_time"), status.alias("status"),
        F.lit(True).alias("target_time_passed"), (hour % 11 != 0).alias("target_reference_received"), "reference", "model_prediction", "persistence_prediction",
        (hour % 7 * 60).cast("double").alias("reference_arrival_lag_seconds"), (hour % 3 * 30).cast("double").alias("evaluation_lag_seconds"),
    )


EXACT = ("reference_source", "evaluation_mode", "metric_scope", "window_hours", "location_id", "sample_count", "forecasts_total", "evaluated_count", "pending_reference_count", "reference_conflict_count", "received_references", "missing_references", "window_complete", "location_count", "locations_evaluated", "locations_model_beats_persistence", "quality_status", "reference_arrival_lag_median_seconds", "reference_arrival_lag_p95_seconds", "reference_arrival_lag_max_seconds", "evaluation_lag_median_seconds")
ROUNDED = ("model_mae", "model_rmse", "model_bias", "persistence_mae", "persistence_rmse", "mae_improvement_c", "mae_improvement_pct", "mae_skill", "macro_location_mae", "reference_coverage_pct", "evaluation_coverage_pct")


def _sql(window: int, by_place: bool, samples: int, places: int) -> str:
    scope, place, group = ("LOCATION", "location_id", ", location_id") if by_place else ("GLOBAL", "CAST(NULL AS VARCHAR)", "")
    by = f"reference_source, evaluation_mode, target{group}"
    mae = "avg(abs({0} - reference)) FILTER (ok)"
    m, p = mae.format("m"), mae.format("p")
    share = lambda a, b: s6(f"{a} * 100.0 / nullif({b}, 0)")
    return f"""WITH {SCORED}, {RATED}, ends AS (SELECT DISTINCT reference_source, evaluation_mode, target_time AS target FROM rated),
w AS (SELECT rated.*, target, status = 'EVALUATED' AS ok FROM rated JOIN ends e ON rated.reference_source = e.reference_source AND rated.evaluation_mode = e.evaluation_mode
  AND target_time <= target AND target_time > target - INTERVAL {window} HOUR),
k AS (SELECT reference_source, evaluation_mode, target, location_id, {m} AS own, {p} AS base FROM w GROUP BY ALL),
places AS (SELECT {by}, avg(own) AS macro, count(own) AS evaluated, count(*) FILTER (own < base) AS beats FROM k GROUP BY ALL),
g AS (SELECT {by}, count(*) FILTER (ok) AS n, count(*) AS total, count(*) FILTER (status = 'PENDING_REFERENCE') AS pending, count(*) FILTER (status = 'REFERENCE_CONFLICT') AS conflict, count(*) FILTER (received) AS received,
  count(DISTINCT location_id) FILTER (ok) AS places, {m} AS mm, {p} AS pm, sqrt(avg((m - reference) * (m - reference)) FILTER (ok)) AS mr, sqrt(avg((p - reference) * (p - reference)) FILTER (ok)) AS pr,
  avg(m - reference) FILTER (ok) AS bias, quantile_cont(arrival, 0.5) FILTER (ok) AS a50, quantile_cont(arrival, 0.95) FILTER (ok) AS a95, max(arrival) FILTER (ok) AS a100, quantile_cont(lag, 0.5) FILTER (ok) AS l50 FROM w GROUP BY ALL)
SELECT reference_source, evaluation_mode, '{scope}' AS metric_scope, {window} AS window_hours, {place} AS location_id, {sec('target')} AS target_second, n AS sample_count, total AS forecasts_total, n AS evaluated_count,
  pending AS pending_reference_count, conflict AS reference_conflict_count, received AS received_references, total - received AS missing_references, n = {samples} AND places = {places} AS window_complete,
  CAST(places AS INTEGER) AS location_count, CAST(evaluated AS INTEGER) AS locations_evaluated, CAST(beats AS INTEGER) AS locations_model_beats_persistence,
  CASE WHEN n < 2 THEN 'INSUFFICIENT_SAMPLE' WHEN mm < pm THEN 'MODEL_BEATS_PERSISTENCE' WHEN mm > pm THEN 'MODEL_TRAILS_PERSISTENCE' ELSE 'MODEL_EQUALS_PERSISTENCE' END AS quality_status,
  a50 AS reference_arrival_lag_median_seconds, a95 AS reference_arrival_lag_p95_seconds, a100 AS reference_arrival_lag_max_seconds, l50 AS evaluation_lag_median_seconds,
  {s6('mm')} AS model_mae, {s6('mr')} AS model_rmse, {s6('bias')} AS model_bias, {s6('pm')} AS persistence_mae, {s6('pr')} AS persistence_rmse, {s6('pm - mm')} AS mae_improvement_c,
  {s6('(pm - mm) / nullif(pm, 0) * 100')} AS mae_improvement_pct, {s6('1 - mm / nullif(pm, 0)')} AS mae_skill, {s6('macro')} AS macro_location_mae,
  {share('received', 'total')} AS reference_coverage_pct, {share('n', 'total')} AS evaluation_coverage_pct FROM g JOIN places USING ({by})"""


def _shown(records):
    return records.select(*EXACT, seconds("target_time").alias("target_second"), *(six(F.col(c)).alias(c) for c in ROUNDED))


@query(_sql(24, False, 100, 5))
def metric_records_global(spark, d):
    """CMP-13: the 24 hours that end at each target hour, over all places."""
    return _shown(metric_records(rated(spark, d), 24, False, 100, 5, least=2))


@query(_sql(6, True, 4, 1))
def metric_records_by_place(spark, d):
    """CMP-13: the 6 hours that end at each target hour, for each place."""
    return _shown(metric_records(rated(spark, d), 6, True, 4, 1, least=2))
