"""Queries: what makes forecasts, observations and catalogs invalid, leads, and the rest of a metric record (§2.1, 2.3, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import six
from ..operators import evaluate, quality, state
from ..operators.records import metric_records
from ..sources import readers
from .base import OBS, PANEL, SCORED, load, observations, panel, query, s6, scored, sec, seconds
from .joins_slate import STATUS, _status
from .record_slate import RATED, rated

TOLD = evaluate.Provenance(73, 2, "P", "M", "L", "live", "R", "hist")
H = "CAST(epoch(event_time) / 3600 AS BIGINT)"
#: Forecasts of two hours ahead with a fault in every field, by hour.
TWO_HOURS = f"""raw AS (SELECT location_id, event_time, {H} AS h, CASE WHEN {H} % 31 = 0 THEN NULL WHEN {H} % 29 = 0 THEN 'OTHER' WHEN {H} % 3 = 1 THEN 'REPLAY_VALIDATION' ELSE 'LIVE_PROSPECTIVE' END AS origin,
  event_time + CASE WHEN {H} % 47 = 0 THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END AS feature_time,
  CASE WHEN {H} % 59 = 0 THEN NULL WHEN {H} % 7 = 0 THEN event_time + INTERVAL 130 MINUTE WHEN {H} % 11 = 0 THEN event_time + INTERVAL 30 MINUTE ELSE event_time + INTERVAL 61 MINUTE END AS made FROM panel),
made AS (SELECT *, feature_time + INTERVAL 2 HOUR AS target_time, h % 4 <> 0 AND h % 47 <> 0 AS judged, CASE WHEN h % 73 = 0 THEN NULL WHEN h % 71 = 0 THEN made + INTERVAL 1 MINUTE ELSE made - INTERVAL 1 MINUTE END AS seen,
  CASE WHEN h % 13 = 0 THEN 'elsewhere' WHEN h % 43 = 0 THEN '' WHEN origin = 'REPLAY_VALIDATION' THEN 'hist' ELSE 'live' END AS endpoint,
  CASE WHEN h % 17 = 0 THEN 'S' WHEN origin = 'REPLAY_VALIDATION' THEN 'R' ELSE 'L' END AS src,
  CASE WHEN h % 67 = 0 THEN NULL ELSE epoch(feature_time + INTERVAL 2 HOUR) - epoch(made) + CASE WHEN h % 61 = 0 THEN 1 ELSE 0 END END AS lead FROM raw),
known AS (SELECT *, judged AND made IS NOT NULL AND lead IS NOT NULL AND seen IS NOT NULL AS readable FROM made)"""


def _two_hours(spark, d):
    h, minutes = F.floor(F.unix_seconds("event_time") / 3600), lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))
    origin = F.when(h % 31 == 0, None).when(h % 29 == 0, "OTHER").when(h % 3 == 1, "REPLAY_VALIDATION").otherwise("LIVE_PROSPECTIVE")
    time, replay = F.col("event_time"), F.coalesce(F.col("execution_origin") == "REPLAY_VALIDATION", F.lit(False))
    rows = panel(spark, d).select("location_id", "event_time", h.alias("h"), origin.alias("execution_origin"))
    rows = rows.withColumn("feature_time", F.when(h % 47 == 0, time + minutes(5)).otherwise(time))
    rows = rows.withColumn("inference_time", F.when(h % 59 == 0, None).when(h % 7 == 0, time + minutes(130)).when(h % 11 == 0, time + minutes(30)).otherwise(time + minutes(61)))
    rows = rows.withColumn("target_time", F.col("feature_time") + minutes(120))
    lead = evaluate.lead_seconds(F.col("target_time"), F.col("inference_time"))
    return rows.withColumns({
        "feature_count": F.when(h % 19 == 0, 72).otherwise(73),
        "forecast_horizon_hours": F.when(h % 23 == 0, 1).otherwise(2),
        "provider": F.when(h % 37 == 0, "Q").otherwise("P"),
        "provider_model": F.when(h % 41 != 0, "M"),
        "provider_endpoint": F.when(h % 13 == 0, "elsewhere").when(h % 43 == 0, "").when(replay, "hist").otherwise("live"),
        "source": F.when(h % 17 == 0, "S").when(replay, "R").otherwise("L"),
        "source_event_id": F.when(h % 53 != 0, "e"),
        "source_retrieved_at": F.when(h % 73 == 0, None).when(h % 71 == 0, F.col("inference_time") + minutes(1)).otherwise(F.col("inference_time") - minutes(1)),
        "forecast_lead_seconds": F.when(h % 67 == 0, float("nan")).otherwise(lead + F.when(h % 61 == 0, 1).otherwise(0)),
    })


_CODES = {
    "INVALID_FEATURE_COUNT": "judged AND h % 19 = 0",
    "INVALID_FORECAST_HORIZON_HOURS": "judged AND h % 23 = 0",
    "INVALID_EXECUTION_ORIGIN": "judged AND (origin IS NULL OR origin = 'OTHER')",
    "INVALID_T2H_PROVIDER": "judged AND (h % 37 = 0 OR h % 41 = 0)",
    "INVALID_T2H_PROVENANCE": "judged AND (endpoint = '' OR h % 53 = 0)",
    "INVALID_FORECAST_LEAD": "judged AND (NOT readable OR h % 61 = 0)",
    "INVALID_SOURCE_RETRIEVAL_TIME": "readable AND seen > made",
    "INVALID_LIVE_SOURCE": "readable AND origin = 'LIVE_PROSPECTIVE' AND (src <> 'L' OR endpoint <> 'live')",
    "NON_POSITIVE_LIVE_FORECAST_LEAD": "readable AND origin = 'LIVE_PROSPECTIVE' AND (target_time <= made OR lead <= 0)",
    "INVALID_COMPLETED_SAFE_HOUR": "readable AND origin = 'LIVE_PROSPECTIVE' AND feature_time > date_trunc('hour', made) - INTERVAL 1 HOUR",
    "INVALID_REPLAY_SOURCE": "readable AND origin = 'REPLAY_VALIDATION' AND (src <> 'R' OR endpoint <> 'hist')",
}


def _listed(codes: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {condition} THEN '{code}' END" for code, condition in codes.items())
    return f"array_to_string(list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)), ';')"


@query(f"WITH {PANEL}, {TWO_HOURS} SELECT location_id, {sec('event_time')} AS second, {_listed(_CODES)} AS errors FROM known")
def forecast_provenance(spark, d):
    """FLT-10: the eleven codes of the two-hour contract; every fourth forecast is another model's."""
    errors = quality.all_errors(evaluate.provenance_errors(TOLD, F.col("h") % 4 != 0))
    return _two_hours(spark, d).select("location_id", seconds("event_time").alias("second"), errors.alias("errors"))


_FAULTY = f"""seen AS (SELECT event_id AS i, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '' ELSE 'LIVE' END AS source, CASE WHEN event_id % 17 = 0 THEN 'nowhere' ELSE location_id END AS location_id,
  event_id % 41 = 0 AS nameless, event_id % 19 = 0 AS off, event_id % 23 = 0 AS no_temperature, event_id % 29 = 0 AS infinite, event_id % 31 = 0 AS nan_humidity, event_id % 37 = 0 AS part_code FROM obs)"""
_OBSERVED = {
    "MISSING_SOURCE": "coalesce(source, '') = ''",
    "UNKNOWN_LOCATION": "location_id = 'nowhere'",
    "MISSING_EVENT_ID": "nameless",
    "INVALID_EVENT_TIME": "off",
    "INVALID_WEATHER_PAYLOAD:temperature_c is required": "no_temperature",
    "INVALID_WEATHER_PAYLOAD:temperature_c must be finite": "infinite AND NOT no_temperature",
    "INVALID_WEATHER_PAYLOAD:humidity_pct must be finite": "nan_humidity AND NOT no_temperature AND NOT infinite",
    "INVALID_WEATHER_PAYLOAD:weather_code must be an integer": "part_code AND NOT no_temperature AND NOT infinite AND NOT nan_humidity",
}


@query(f"WITH {OBS}, {_FAULTY} SELECT i, {_listed(_OBSERVED)} AS errors FROM seen")
def observation_faults(spark, d):
    """FLT-10: the codes of observations with planted faults."""
    i = F.col("event_id")
    hour = F.date_trunc("hour", "event_time")
    rows = observations(spark, d).select(
        i.alias("i"), F.when(i % 11 == 0, None).when(i % 13 == 0, "").otherwise("LIVE").alias("source"), F.when(i % 17 == 0, "nowhere").otherwise(F.col("location_id")).alias("location_id"),
        F.when(i % 41 != 0, i).alias("event_id"), F.when(i % 19 == 0, hour + F.expr("INTERVAL 1 SECOND")).otherwise(hour).alias("event_time"),
        F.when(i % 23 == 0, None).when(i % 29 == 0, float("inf")).otherwise(20.0).alias("temperature_c"), F.when(i % 31 == 0, float("nan")).otherwise(F.col("humidity_pct")).alias("humidity_pct"),
        F.when(i % 37 == 0, 1.5).otherwise(3.0).alias("weather_code"),
    )
    errors = evaluate.observation_errors(F.col("location_id") != "nowhere", ["temperature_c", "humidity_pct"])
    return rows.select("i", quality.all_errors(errors).alias("errors"))


@query(f"""WITH {PANEL}, {STATUS}, x AS (SELECT location_id, event_time, status, event_time + INTERVAL 2 HOUR AS target, event_time + {H} % 150 * INTERVAL 1 MINUTE AS made FROM status)
SELECT location_id, {sec('event_time')} AS second, CASE WHEN status = 'HISTORY_GAP' THEN 'GAP_IN_HISTORY' WHEN status <> 'READY' THEN status WHEN {H} % 2 = 0 AND target <= made THEN 'NON_PROSPECTIVE_SKIPPED' ELSE 'READY' END AS outcome,
  CAST(epoch(target) - epoch(made) AS DOUBLE) AS lead_seconds, epoch(target) - epoch(made) >= 3600 AS useful FROM x""")
def prospective_leads(spark, d):
    """CMP-07: outcomes with the time that each forecast is ahead, and whether an hour at least; every second hour is live."""
    hour, target = F.floor(F.unix_seconds("event_time") / 3600), F.col("event_time") + F.expr("INTERVAL 2 HOURS")
    made = F.col("event_time") + F.make_dt_interval(F.lit(0), F.lit(0), (hour % 150).cast("int"))
    lead = evaluate.lead_seconds(target, made)
    outcome = state.prospective_status(F.col("status"), target, made, F.lit(True), hour % 2 == 0)
    return _status(spark, d).select("location_id", seconds("event_time").alias("second"), outcome.alias("outcome"), lead.cast("double").alias("lead_seconds"), state.useful_lead(lead, 3600).alias("useful"))


RULES = readers.CatalogRules(
    required=("location_id", "province_name", "admin_type", "latitude", "longitude", "country_code"), kinds={"PROVINCE": 20, "CENTRAL_CITY": 5}, fixed={"country_code": "VN"},
    latitude=(8.0, 24.5), longitude=(102.0, 130.0), whole_set="ALL", subset="SOME", subset_ids=("VN_1", "VN_2", "VN_99"), prefix="VN_",
)


@query("""WITH c AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN 'X_3' WHEN n_nationkey = 4 THEN 'VN_5' ELSE 'VN_' || n_nationkey END AS location_id, CASE WHEN n_nationkey = 6 THEN NULL ELSE n_name END AS name,
  CASE WHEN n_nationkey % 5 = 0 THEN 'CENTRAL_CITY' WHEN n_nationkey = 8 THEN 'TOWN' ELSE 'PROVINCE' END AS kind FROM nation),
f AS (SELECT location_id, unnest(list_filter([CASE WHEN k = 3 THEN 'INVALID_LOCATION_ID' END, CASE WHEN k = 6 THEN 'MISSING_PROVINCE_NAME' END, CASE WHEN k = 8 THEN 'INVALID_ADMIN_TYPE' END, CASE WHEN k = 9 THEN 'INVALID_COUNTRY_CODE' END,
  CASE WHEN k = 10 THEN 'MISSING_LATITUDE' END, CASE WHEN k = 10 THEN 'COORDINATE_NOT_NUMERIC' END, CASE WHEN k = 11 THEN 'COORDINATE_OUT_OF_RANGE' END, CASE WHEN k IN (11, 12) THEN 'COORDINATE_OUT_OF_ENVELOPE' END,
  CASE WHEN k = 13 THEN 'NOT_IN_WHOLE_SET' END, CASE WHEN k = 2 THEN 'WRONG_SUBSET' END], lambda x: x IS NOT NULL)) AS code FROM c)
SELECT location_id, code FROM f UNION ALL SELECT NULL, unnest(['REPEATED_LOCATION_ID', 'REPEATED_NAME', 'REPEATED_COORDINATE', 'SUBSET_INCOMPLETE', 'WRONG_COUNT_PROVINCE'])""")
def catalog_faults(spark, d):
    """SRC-15: a catalog of places with each rule broken once."""
    k = F.col("n_nationkey")
    sets = F.when(k == 13, F.array(F.lit("NONE"))).when(k == 1, F.array(F.lit("ALL"), F.lit("SOME"))).otherwise(F.array(F.lit("ALL")))
    places = load(spark, d, "nation").select(
        F.when(k == 3, "X_3").when(k == 4, "VN_5").otherwise(F.concat(F.lit("VN_"), k)).alias("location_id"), F.when(k != 6, F.col("n_name")).alias("province_name"),
        F.when(k % 5 == 0, "CENTRAL_CITY").when(k == 8, "TOWN").otherwise("PROVINCE").alias("admin_type"), F.when(k == 9, "XX").otherwise("VN").alias("country_code"),
        F.when(k == 10, None).when(k == 11, 95.0).when(k == 12, 60.0).when(k == 15, 8.5 + 14 * 0.5).otherwise(8.5 + k * 0.5).alias("latitude"), F.when(k == 15, 103.0 + 14).otherwise(103.0 + k).alias("longitude"), sets.alias("dataset_memberships"),
    )
    return readers.catalog_errors(places, RULES)





def _r2(x: str) -> str:
    return f"CASE WHEN count(*) FILTER (ok) >= 2 AND var_pop(reference) FILTER (ok) > 0 THEN 1 - sum(({x} - reference) * ({x} - reference)) FILTER (ok) / (var_pop(reference) FILTER (ok) * count(*) FILTER (ok)) END"


@query(f"""WITH {SCORED}, {RATED}, ends AS (SELECT DISTINCT reference_source, evaluation_mode, target_time AS target FROM rated),
w AS (SELECT rated.*, target, status = 'EVALUATED' AS ok FROM rated JOIN ends e ON rated.reference_source = e.reference_source AND rated.evaluation_mode = e.evaluation_mode AND target_time <= target AND target_time > target - INTERVAL 24 HOUR),
k AS (SELECT reference_source, target, location_id, avg(abs(m - reference)) FILTER (ok) AS own, avg(abs(p - reference)) FILTER (ok) AS base FROM w GROUP BY ALL),
places AS (SELECT reference_source, target, count(*) FILTER (own >= base) AS trails FROM k GROUP BY ALL),
g AS (SELECT reference_source, evaluation_mode, target, count(*) AS total, {_r2('m')} AS model_r2, {_r2('p')} AS persistence_r2, avg(p - reference) FILTER (ok) AS pb, avg(abs(m - reference)) FILTER (ok) AS mm,
  sqrt(avg((m - reference) * (m - reference)) FILTER (ok)) AS mr, sqrt(avg((p - reference) * (p - reference)) FILTER (ok)) AS pr, quantile_cont(lag, 0.95) FILTER (ok) AS l95, max(lag) FILTER (ok) AS l100,
  quantile_cont(reference, 0.5) FILTER (ok) AS r50, avg(m) FILTER (ok) AS mean_m, min(p) FILTER (ok) AS min_p, count(*) FILTER (ok) AS n FROM w GROUP BY ALL)
SELECT reference_source, {sec('target')} AS target_second, sha256('FORECAST_METRIC' || chr(0) || '1' || chr(0) || reference_source || chr(0) || evaluation_mode || chr(0) || 'GLOBAL' || chr(0) || '24' || chr(0) || strftime(target, '%Y-%m-%dT%H:%M:%SZ') || chr(0)) AS metric_id,
  '1' AS metric_version, CAST(100 AS BIGINT) AS expected_sample_count, total AS expected_references, total AS forecasts_target_time_passed, CAST(0 AS BIGINT) AS pending_target_count, CAST(0 AS BIGINT) AS invalid_count, CAST(5 AS INTEGER) AS expected_location_count,
  CAST(trails AS INTEGER) AS locations_model_equals_or_trails_persistence, l95 AS evaluation_lag_p95_seconds, l100 AS evaluation_lag_max_seconds, {s6('model_r2')} AS model_r2, {s6('persistence_r2')} AS persistence_r2, {s6('pb')} AS persistence_bias,
  {s6('pr - mr')} AS rmse_improvement_c, {s6('(pr - mr) / nullif(pr, 0) * 100')} AS rmse_improvement_pct, {s6('mm')} AS micro_global_mae, {s6('r50')} AS reference_p50, {s6('mean_m')} AS prediction_mean, {s6('min_p')} AS persistence_min, nullif(n, 0) AS reference_count
FROM g JOIN places USING (reference_source, target)""")
def metric_records_rest(spark, d):
    """CMP-13: what metric_records_global leaves out: ids, r2, further improvements, counts, lags and the distributions."""
    r = metric_records(rated(spark, d), 24, False, 100, 5, least=2)
    told = lambda c, part: F.get_json_object("distribution_json", f"$.{c}.{part}").cast("double")
    exact = ["metric_id", "metric_version", "expected_sample_count", "expected_references", "forecasts_target_time_passed", "pending_target_count", "invalid_count", "expected_location_count", "locations_model_equals_or_trails_persistence", "evaluation_lag_p95_seconds", "evaluation_lag_max_seconds"]
    rounded = ["model_r2", "persistence_r2", "persistence_bias", "rmse_improvement_c", "rmse_improvement_pct", "micro_global_mae"]
    shapes = {"reference_p50": told("reference", "p50"), "prediction_mean": told("model_prediction", "mean"), "persistence_min": told("persistence_prediction", "min")}
    return r.select(
        "reference_source", seconds("target_time").alias("target_second"), *exact, *(six(F.col(c)).alias(c) for c in rounded), *(six(v).alias(k) for k, v in shapes.items()),
        F.get_json_object("distribution_json", "$.reference.count").cast("long").alias("reference_count"),
    )
