"""Delayed evaluation of forecasts (CMP-10/11/12, JON-12/13/14, FLT-10): one status for each forecast.

The order of statuses is their meaning; the first that applies holds:
EVALUATED before (kept), INVALID_PROVENANCE, PENDING_BASELINE, REFERENCE_CONFLICT (feature hour), PENDING_TARGET_TIME,
REFERENCE_CONFLICT (target hour), PENDING_REFERENCE, EVALUATED.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.times import aligned
from .features import hours
from .quality import all_errors

LIVE, BACKFILL = "LIVE_PROSPECTIVE", "LIVE_SOURCE_BACKFILL"


def mode(source: Column, retrieval: Column, origin: Column, live_source: str) -> Column:
    """CMP-11."""
    live = F.when(retrieval == BACKFILL, BACKFILL).otherwise(LIVE)
    same = F.coalesce(source == live_source, F.lit(False))
    chain = F.when(origin.isin("REPLAY_VALIDATION", "BACKFILL"), "REPLAY")
    chain = chain.when((origin == LIVE) & ~same, "UNCLASSIFIED").when(same, live)
    return chain.when(F.coalesce(source, F.lit("")) != "", "REPLAY").otherwise("UNCLASSIFIED")


def references(observations: DataFrame) -> DataFrame:
    """One row per source, location and hour: the first payload, and whether payloads differ.

    ``observations`` has source, location_id, event_time, event_id, payload, value, ingestion_time and, if it is known how
    they were retrieved, retrieval_mode.
    """
    if "retrieval_mode" not in observations.columns:
        observations = observations.withColumn("retrieval_mode", F.lit(None).cast("string"))
    kept = F.struct("event_id", "payload", "value", "ingestion_time", "retrieval_mode")
    first = F.min_by(kept, F.struct("ingestion_time", "payload"))
    grouped = observations.groupBy("source", "location_id", "event_time").agg(first.alias("ref"), (F.countDistinct("payload") > 1).alias("conflict"), F.count("*").alias("copies"))
    return grouped.select("source", "location_id", "event_time", "ref.*", "conflict", "copies")


def forecasts_once(forecasts: DataFrame, key: str = "forecast_id") -> DataFrame:
    """CMP-12: one row per id, the smallest of its signatures; ``conflicting`` where an id has several."""
    signature = F.struct(*(c for c in sorted(forecasts.columns) if c != key))
    grouped = forecasts.groupBy(key).agg(F.min(signature).alias("s"), (F.countDistinct(F.to_json(signature)) > 1).alias("conflicting"))
    return grouped.select(key, "s.*", "conflicting")


def forecast_errors(horizon_hours: int, expected_id: Column | None, contract: dict[str, str], columns: list[str]) -> dict[str, Column]:
    """FLT-10: what makes a forecast invalid, by code; a column _known marks known locations.

    ``contract`` names the value that a column must have (model, digests); ``expected_id`` the deterministic id.  Horizon
    and id are judged only where both times are whole hours.
    """
    whole = F.coalesce(aligned(F.col("feature_time")) & aligned(F.col("target_time")), F.lit(False))
    named = F.coalesce(F.col("forecast_id"), F.lit("")) != ""
    found = {
        "UNKNOWN_LOCATION": F.col("_known").isNull(),
        "MISSING_FORECAST_ID": ~named,
        "INVALID_FORECAST_TIME": ~whole,
        "INVALID_FORECAST_HORIZON": whole & (F.col("target_time") != F.col("feature_time") + hours(horizon_hours)),
        "INVALID_PREDICTION": ~finite(F.col("prediction")),
        "CONFLICTING_FORECAST_ID": F.col("conflicting"),
    }
    if expected_id is not None:
        found["INVALID_FORECAST_ID"] = whole & named & ~F.coalesce(F.col("forecast_id") == expected_id, F.lit(False))
    if "inference_time" in columns:
        found["INVALID_INFERENCE_TIME"] = F.col("inference_time").isNull()
    for column, value in contract.items():
        found[f"UNSUPPORTED_{column.upper()}"] = ~F.col(column).eqNullSafe(F.lit(value))
    return found


@dataclass(frozen=True)
class Provenance:
    """What the two-hour contract fixes beside the model: how forecasts are made, by whom, and from which sources."""

    feature_count: int
    horizon_hours: int
    provider: str
    provider_model: str
    live_source: str
    live_endpoint: str
    replay_source: str
    replay_endpoint: str


# Origins of a forecast, and the codes of forecasts and observations.
ORIGINS = (LIVE, "REPLAY_VALIDATION", "BACKFILL")
NO_SOURCE, NO_EVENT, BAD_TIME, BAD_PAYLOAD = "MISSING_SOURCE", "MISSING_EVENT_ID", "INVALID_EVENT_TIME", "INVALID_WEATHER_PAYLOAD"


def lead_seconds(target: Column, now: Column) -> Column:
    """CMP-07: how long before its target a forecast is made, with fractions."""
    return (F.unix_micros(target) - F.unix_micros(now)) / 1e6


def provenance_errors(told: Provenance, applies: Column) -> dict[str, Column]:
    """FLT-10, the codes of the two-hour contract, where ``applies`` is true and both times are whole hours.

    Columns: feature_count, forecast_horizon_hours, execution_origin, provider, provider_model, provider_endpoint,
    source, source_event_id, source_retrieved_at, inference_time and forecast_lead_seconds.  Without a readable
    inference time, lead and retrieval time the lead is invalid and nothing that rests on them is judged.
    """
    on = F.coalesce(applies & aligned(F.col("feature_time")) & aligned(F.col("target_time")), F.lit(False))
    c, empty = F.col, lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    differs = lambda name, value: ~c(name).eqNullSafe(F.lit(value))
    lead, made, seen = c("forecast_lead_seconds"), c("inference_time"), c("source_retrieved_at")
    readable = made.isNotNull() & finite(lead) & seen.isNotNull()
    due = lead_seconds(c("target_time"), made)
    live, replay = on & readable & c("execution_origin").eqNullSafe(F.lit(LIVE)), on & readable & c("execution_origin").eqNullSafe(F.lit("REPLAY_VALIDATION"))
    return {
        "INVALID_FEATURE_COUNT": on & differs("feature_count", told.feature_count),
        "INVALID_FORECAST_HORIZON_HOURS": on & differs("forecast_horizon_hours", told.horizon_hours),
        "INVALID_EXECUTION_ORIGIN": on & ~F.coalesce(c("execution_origin").isin(*ORIGINS), F.lit(False)),
        "INVALID_T2H_PROVIDER": on & (differs("provider", told.provider) | differs("provider_model", told.provider_model)),
        "INVALID_T2H_PROVENANCE": on & (empty("provider_endpoint") | empty("source_event_id")),
        "INVALID_FORECAST_LEAD": on & (~readable | F.coalesce(lead != due, F.lit(True))),
        "INVALID_SOURCE_RETRIEVAL_TIME": on & readable & (seen > made),
        "INVALID_LIVE_SOURCE": live & (differs("source", told.live_source) | differs("provider_endpoint", told.live_endpoint)),
        "NON_POSITIVE_LIVE_FORECAST_LEAD": live & ((c("target_time") <= made) | (lead <= 0)),
        "INVALID_COMPLETED_SAFE_HOUR": live & (c("feature_time") > F.date_trunc("hour", made) - hours(1)),
        "INVALID_REPLAY_SOURCE": replay & (differs("source", told.replay_source) | differs("provider_endpoint", told.replay_endpoint)),
    }


def observation_errors(known: Column, values: list[str], required: str = "temperature_c", code: str = "weather_code", time: str = "event_time") -> dict[str, Column]:
    """FLT-10 of observations, by code; a column for each of ``values`` and ``code`` (may be null, else a whole number).

    A payload's code names the first of ``values``, in their order, that is wrong: ``required`` is there, all are finite.
    """
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) == ""
    faults = []
    for v in values:
        if v == required:
            faults.append((F.col(v).isNull(), f"{v} is required"))
        faults.append((F.col(v).isNotNull() & ~finite(F.col(v)), f"{v} must be finite"))
    faults.append((F.col(code).isNotNull() & ~finite(F.col(code)), f"{code} must be finite"))
    faults.append((F.col(code).isNotNull() & (F.col(code).cast("double") != F.floor(F.col(code).cast("double"))), f"{code} must be an integer"))
    first, found = F.lit(False), {}
    for fault, told in faults:
        found[f"{BAD_PAYLOAD}:{told}"] = fault & ~first
        first = first | fault
    return {
        NO_SOURCE: empty("source"),
        "UNKNOWN_LOCATION": empty("location_id") | ~F.coalesce(known, F.lit(False)),
        NO_EVENT: empty("event_id"),
        BAD_TIME: ~F.coalesce(aligned(F.col(time)), F.lit(False)),
        **found,
    }


def evaluate(
    forecasts: DataFrame,
    observations: DataFrame,
    known: DataFrame,
    now: Column,
    *,
    horizon_hours: int = 1,
    expected_id: Column | None = None,
    contract: dict[str, str] | None = None,
    checks: dict[str, Column] | None = None,
    prior: DataFrame | None = None,
    live_source: str = "LIVE",
) -> DataFrame:
    """A current row for each forecast id.

    ``forecasts``: forecast_id, location_id, feature_time, target_time, prediction, source_event_id, execution_origin.
    ``checks`` adds error codes to those of ``forecast_errors``.
    ``prior``: forecast ids already EVALUATED, which are left out here and kept by the caller's merge.
    """
    once = forecasts_once(forecasts)
    if prior is not None:
        once = once.join(prior.filter("status = 'EVALUATED'").select("forecast_id"), "forecast_id", "left_anti")
    marked = once.join(known.select("location_id").distinct().withColumn("_known", F.lit(True)), "location_id", "left")
    errors = all_errors(forecast_errors(horizon_hours, expected_id, contract or {}, forecasts.columns) | (checks or {}))
    refs = references(observations)
    feature = refs.select("location_id", F.col("event_time").alias("feature_time"), F.col("event_id").alias("source_event_id"), F.struct("source", "payload", "value", "conflict").alias("f"))
    one = feature.groupBy("location_id", "feature_time", "source_event_id").agg(F.min("f").alias("f"), F.count("*").alias("_found")).filter("_found = 1").drop("_found")
    joined = marked.withColumn("errors", errors).join(one, ["location_id", "feature_time", "source_event_id"], "left").withColumn("source", F.col("f.source"))
    target = refs.select("source", "location_id", F.col("event_time").alias("target_time"), F.struct("event_id", "value", "ingestion_time", "conflict", "retrieval_mode").alias("t"))
    joined = joined.join(target, ["source", "location_id", "target_time"], "left")
    passed = F.coalesce(F.col("target_time") <= now, F.lit(False))
    there, clash = F.col("t").isNotNull(), F.coalesce(F.col("t.conflict"), F.lit(False))
    status = (
        F.when(F.col("errors") != "", "INVALID_PROVENANCE")
        .when(F.col("f").isNull(), "PENDING_BASELINE")
        .when(F.col("f.conflict"), "REFERENCE_CONFLICT")
        .when(~passed, "PENDING_TARGET_TIME")
        .when(clash, "REFERENCE_CONFLICT")
        .when(~there, "PENDING_REFERENCE")
        .otherwise("EVALUATED")
    )
    reason = (
        F.when(F.col("errors") != "", F.col("errors"))
        .when(F.col("f").isNull() & (F.coalesce(F.col("source_event_id"), F.lit("")) == ""), "SOURCE_EVENT_ID_MISSING")
        .when(F.col("f").isNull(), "FEATURE_TIME_REFERENCE_MISSING_OR_AMBIGUOUS")
        .when(F.col("f.conflict"), "FEATURE_TIME_REFERENCE_REVISION_DETECTED")
        .when(passed & clash, "TARGET_TIME_REFERENCE_REVISION_DETECTED")
    )
    shaped = joined.withColumn("status", status).withColumn("invalid_reason", reason)
    done = F.col("status") == "EVALUATED"
    model_error, base_error = F.when(done, F.col("prediction") - F.col("t.value")), F.when(done, F.col("f.value") - F.col("t.value"))
    clean = F.col("errors") == ""
    return shaped.select(
        "forecast_id", "location_id", "feature_time", "target_time", F.when(clean, F.col("source")).alias("reference_source"), "status", "invalid_reason",
        passed.alias("target_time_passed"), (clean & passed & there & F.coalesce(~F.col("f.conflict"), F.lit(False))).alias("target_reference_received"),
        F.col("prediction").alias("model_prediction"), F.when(clean & ~F.coalesce(F.col("f.conflict"), F.lit(True)), F.col("f.value")).alias("persistence_prediction"),
        F.when(done, F.col("t.value")).alias("reference"), model_error.alias("model_error"), base_error.alias("persistence_error"),
        F.when(done, F.unix_micros("t.ingestion_time") / 1e6 - F.unix_micros("target_time") / 1e6).alias("arrival_lag_seconds"),
        F.when(done, F.unix_micros(now) / 1e6 - F.unix_micros("target_time") / 1e6).alias("evaluation_lag_seconds"),
        mode(F.when(clean, F.col("source")), F.when(clean, F.col("t.retrieval_mode")), F.col("execution_origin"), live_source).alias("evaluation_mode"),
    )
