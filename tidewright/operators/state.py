"""Micro-batch scoring over bounded keyed history (CMP-05/06/07, STR-09/10/11, UDF-01/02).

A batch goes through: first reason to reject, conflicts and duplicates within it, conflicts, duplicates and lateness
against the state, union with the history of touched keys, the range of hours that the batch makes dirty, features and
status of these hours, and a model.  Nothing of it comes to the driver; the caller merges the three results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import forecast_id
from . import dedupe, joins
from .features import hours
from .quality import reject_reason

STATUSES = ("READY", "INSUFFICIENT_HISTORY", "HISTORY_GAP", "DUPLICATE_CONFLICT", "INVALID_FEATURES", "CURRENT_OBSERVATION_MISSING")


@dataclass
class Batch:
    """rejected: with reason; accepted: new rows of the state; candidates: history of the hours to score, and those hours."""

    rejected: DataFrame
    accepted: DataFrame
    history: DataFrame
    candidates: DataFrame


def classify(batch: DataFrame, state: DataFrame, known: DataFrame, values: tuple[str, ...], key: str = "location_id", time: str = "event_time", payload: str = "payload_hash", retention_hours: int = 48, reach_hours: int = 24) -> Batch:
    """``batch`` has key, time, coordinates, values, event_id, offset and payload; ``state`` the same columns."""

    flagged = joins.member_flag(batch, known, [key], "_known")
    reasoned = flagged.withColumn("reason", reject_reason(F.col("_known"), time, values=values)).drop("_known")
    sound = reasoned.filter("reason is null").drop("reason")
    counted = dedupe.versions(sound, [key, time], payload)
    clash = counted.filter("versions > 1").select(key, time)
    conflicts = sound.join(clash, [key, time], "left_semi").withColumn("reason", F.lit("DUPLICATE_CONFLICT"))
    single = dedupe.first_by(sound.join(clash, [key, time], "left_anti"), [key, time], F.col("event_id").asc_nulls_last(), F.col("offset"))
    old = state.select(key, time, F.col(payload).alias("_old"))
    met = single.join(old, [key, time], "left")
    revised = met.filter(F.col("_old") != F.col(payload)).drop("_old").withColumn("reason", F.lit("STATE_CONFLICT"))
    fresh = met.filter("_old is null").drop("_old")
    stale = joins.late(fresh, state, key, time, retention_hours).withColumn("reason", F.lit("LATE_BEYOND_RETENTION"))
    accepted = fresh.join(stale.select(key, time), [key, time], "left_anti")
    columns = [*batch.columns, "reason"]
    rejected = reasoned.filter("reason is not null").select(columns).unionByName(conflicts.select(columns)).unionByName(revised.select(columns)).unionByName(stale.select(columns))
    touched = accepted.select(key).distinct()
    history = dedupe.newest_wins(state.join(touched, key, "left_semi").select(accepted.columns), accepted, [key, time])
    return Batch(rejected, accepted, history, joins.dirty_range(history, accepted, key, time, reach_hours))


def observed_status(
    history: DataFrame, key: str = "location_id", time: str = "event_time", valid: Column | None = None, depth: int = 24, conflicts: DataFrame | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """CMP-06: status of each hour of a history from how many and which of the ``depth`` hours before it are there.

    In this order: an hour of ``conflicts`` (key, time); too few earlier rows; a gap; a conflict among the hours before;
    values that are not valid.  Hours ``asked`` for (key, time) that the history lacks are rows of their own, without values.
    """
    w = Window.partitionBy(key).orderBy(F.unix_seconds(time))
    reach = w.rangeBetween(-depth * 3600, 0)
    seen, rank = F.count("*").over(reach), F.row_number().over(w)
    clean = F.min(F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))).over(reach)
    if conflicts is None:
        marked = history.withColumn("_clash", F.lit(False))
    else:
        marked = history.join(conflicts.select(key, time).distinct().withColumn("_clash", F.lit(True)), [key, time], "left")
        marked = marked.withColumn("_clash", F.coalesce("_clash", F.lit(False)))
    status = F.when(F.col("_clash"), "DUPLICATE_CONFLICT").when(rank <= depth, "INSUFFICIENT_HISTORY").when(seen < depth + 1, "HISTORY_GAP")
    status = status.when(F.max("_clash").over(reach), "DUPLICATE_CONFLICT").when(~clean, "INVALID_FEATURES").otherwise("READY")
    out = marked.withColumn("status", status).drop("_clash").select(*history.columns, "status")
    if asked is None:
        return out
    absent = asked.select(key, time).distinct().join(history.select(key, time), [key, time], "left_anti")
    return out.unionByName(absent.withColumn("status", F.lit("CURRENT_OBSERVATION_MISSING")), allowMissingColumns=True)


def prospective_status(status: Column, target: Column, now: Column, provenance_ok: Column, live: Column) -> Column:
    """CMP-07: of a ready hour, whether its source is right and, if live, its target still ahead."""
    return F.when(status == "HISTORY_GAP", "GAP_IN_HISTORY").when(status != "READY", status).when(~F.coalesce(provenance_ok, F.lit(False)), "INVALID_PROVENANCE").when(live & (target <= now), "NON_PROSPECTIVE_SKIPPED").otherwise("READY")


def useful_lead(lead_seconds: Column, least_seconds: float | None) -> Column:
    """CMP-07: whether a forecast comes early enough to be of use; null where no least lead is agreed."""
    return F.lit(None).cast("boolean") if least_seconds is None else lead_seconds >= least_seconds


def expired(state: DataFrame, key: str = "location_id", time: str = "event_time", retention_hours: int = 48) -> DataFrame:
    """SNK-05, STR-10: keys and times of stored rows beyond the retention of their key's latest row."""
    latest = state.groupBy(key).agg(F.max(time).alias("_latest"))
    return state.join(latest, key).filter(F.col(time) < F.col("_latest") - hours(retention_hours)).select(key, time)


_MODELS: dict[str, object] = {}


def cached_model(name: str, load) -> object:
    """UDF-02: a model loaded once a Python worker."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def score_batches(features: DataFrame, columns: list[str], name: str, load, passthrough: list[str]) -> DataFrame:
    """UDF-01: predictions of a model (``load()`` gives an object with predict(frame)) by Arrow batches, no shuffle.

    ``prediction`` beside the passed columns; rows keep their partitions.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in features.select(*passthrough).schema) + ", prediction double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = cached_model(name, load)
        for frame in frames:
            out = frame[passthrough].copy()
            out["prediction"] = model.predict(frame[columns]) if len(frame) else []
            yield out

    return features.select(*dict.fromkeys([*passthrough, *columns])).mapInPandas(run, schema)


@dataclass
class Outcome:
    """What a micro-batch leaves to be merged: new rows of the state (``batch.accepted``), a status of each candidate hour,
    forecasts that are not there yet, and keys of the state that expire."""

    batch: Batch
    statuses: DataFrame
    forecasts: DataFrame
    expired: DataFrame


def run_batch(
    batch: DataFrame, stored: DataFrame, known: DataFrame, forecasts: DataFrame, values: tuple[str, ...], features: dict[str, Column], columns: list[str], model: str, load,
    key: str = "location_id", time: str = "event_time", valid: Column | None = None, depth: int = 24, horizon: int = 1, retention_hours: int = 48,
) -> Outcome:
    """CMP-05 whole: classify a batch, join it to the state, find the hours that it changes, build their features, score
    those that are READY, and give forecasts deterministic ids.

    ``features`` are window expressions over the history, ``columns`` what the model reads.  Forecasts whose id is in
    ``forecasts`` are left out, so a replay adds none.  The results share their input; persist the batch before using several.
    """
    done = classify(batch, stored, known, values, key, time, retention_hours=retention_hours, reach_hours=depth)
    judged = observed_status(done.history, key, time, valid, depth).select("*", *(v.alias(k) for k, v in features.items()))
    asked = judged.join(done.candidates.select(key, time), [key, time], "left_semi")
    ready = asked.filter("status = 'READY'").withColumnRenamed("event_id", "source_event_id")
    scored = score_batches(ready, columns, model, load, [key, time, "source_event_id"])
    made = scored.select(
        forecast_id(F.lit(model), F.col(key), F.col(time), F.lit(horizon)).alias("forecast_id"), key, F.col(time).alias("feature_time"),
        (F.col(time) + hours(horizon)).alias("target_time"), "prediction", F.lit(model).alias("model_id"), "source_event_id",
    )
    fresh = made.join(forecasts.select("forecast_id"), ["forecast_id"], "left_anti")
    after = stored.select(key, time).unionByName(done.accepted.select(key, time))
    return Outcome(done, asked.select(key, time, "status"), fresh, expired(after, key, time, retention_hours))
