"""The flat metric record of a window of forecasts (CMP-13), for all places or for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id, utc_text
from ..functions.numbers import finite, ratio
from . import sketches
from .features import hours
from .metrics import SUMS, quality_status, regression, sufficient

# The counts of a record, the lags that it has, and the names where source or mode lack.
COUNTS = ("forecasts_total", "forecasts_target_time_passed", "evaluated_count", "pending_target_count", "pending_reference_count", "invalid_count", "reference_conflict_count", "received_references")
LAGS = {"reference_arrival_lag_seconds": "reference_arrival_lag", "evaluation_lag_seconds": "evaluation_lag"}
NO_SOURCE, NO_MODE = "UNKNOWN_SOURCE", "UNCLASSIFIED"

GROUP = ["reference_source", "evaluation_mode"]


def _counts() -> list[Column]:
    status = F.col("status")
    conditions = {
        "forecasts_total": F.lit(True),
        "forecasts_target_time_passed": F.coalesce("target_time_passed", status != "PENDING_TARGET_TIME"),
        "evaluated_count": status == "EVALUATED",
        "pending_target_count": status == "PENDING_TARGET_TIME",
        "pending_reference_count": status.isin("PENDING_REFERENCE", "PENDING_BASELINE"),
        "invalid_count": status == "INVALID_PROVENANCE",
        "reference_conflict_count": status == "REFERENCE_CONFLICT",
        "received_references": F.col("target_reference_received"),
    }
    return [F.count_if(conditions[c]).alias(c) for c in COUNTS]


def _reach(df: DataFrame, ends: DataFrame, window_hours: int) -> DataFrame:
    """Each row at every end hour whose window holds the row's hour."""
    last = F.col("_hour") + hours(window_hours - 1)
    every = df.withColumn("target_time", F.explode(F.sequence("_hour", last, F.expr("INTERVAL 1 HOUR"))))
    return every.join(ends, [*GROUP, "target_time"], "left_semi")


def _distributions(rows: DataFrame, ends: DataFrame, by: list[str], columns: list[str], window_hours: int) -> DataFrame:
    """Distributions of the finite values of ``columns``, by group; equal values of an hour are counted before they spread."""
    cells = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]
    long = rows.select(*GROUP, "_place", "_hour", F.inline(F.array(*cells))).filter(finite(F.col("_value")))
    keys = [*GROUP, "_hour", "_column", *(["_place"] if "_place" in by else [])]
    counted = _reach(long.groupBy(*keys, "_value").agg(F.count("*").alias("_n")), ends, window_hours)
    p = F.percentile("_value", [0.05, 0.5, 0.95], F.col("_n"))
    stats = F.struct(
        F.sum("_n").alias("count"),
        (F.sum(F.col("_value") * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.min("_value").alias("min"),
        p[0].alias("p05"),
        p[1].alias("p50"),
        p[2].alias("p95"),
        F.max("_value").alias("max"),
    )
    return _mapped(counted.groupBy(*by, "_column").agg(stats.alias("_stats")), by)


def _sketched(rows: DataFrame, ends: DataFrame, by: list[str], columns: list[str], window_hours: int, k: int) -> DataFrame:
    """``_distributions`` with percentiles from hourly sketches of ``k``, which windows merge; no value spreads over hours."""
    cells = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]
    long = rows.select(*GROUP, "_place", "_hour", F.inline(F.array(*cells)))
    keys = [*GROUP, "_column", *(["_place"] if "_place" in by else [])]
    merged = sketches.blocks(sketches.hourly(long, keys, "_hour", "_value", k), keys, window_hours, k)
    asked = ends.select(*GROUP, F.floor(F.unix_seconds("target_time") / 3600).alias("end"))
    found = sketches.windows(merged, keys, asked, window_hours, GROUP, k)
    p = {name: sketches.quantile(share) for name, share in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))}
    stats = F.struct(
        F.col("n").alias("count"),
        (F.col("total") / F.col("n")).alias("mean"),
        F.col("least").alias("min"),
        *(v.alias(name) for name, v in p.items()),
        F.col("most").alias("max"),
    )
    return _mapped(found.withColumn("target_time", F.timestamp_seconds(F.col("end") * 3600)).select(*by, "_column", stats.alias("_stats")), by)


def _mapped(each: DataFrame, by: list[str]) -> DataFrame:
    """``_shapes``: from a column's name to its statistics."""
    entries = F.array_sort(F.collect_list(F.struct("_column", "_stats")))  # one for each of the columns
    return each.groupBy(*by).agg(F.map_from_entries(entries).alias("_shapes"))


def metric_records(df: DataFrame, window_hours: int, by_place: bool, expected_samples: int, expected_places: int | None = None, columns: tuple[str, ...] = (), version: str = "1", least: int = 1, sketch_k: int | None = None) -> DataFrame:
    """The 53 columns of a record for each source, mode and target hour (and place) over the ``window_hours`` that end there.

    ``df`` has reference_source, evaluation_mode, location_id, target_time, status, target_time_passed,
    target_reference_received, reference, model_prediction, persistence_prediction and the two lags in seconds; ``columns``
    are further ones whose distributions go into distribution_json.  Only EVALUATED rows with finite numbers are measured;
    all rows count.  A null source or mode gets its own name, a null place is a place.  Rows are summed by place and hour
    before they reach the windows they belong to, so metrics cost by hours and not by rows.  Distributions count equal
    values of an hour first; values that seldom repeat cost about rows times ``window_hours``.  With ``sketch_k`` percentiles
    come from mergeable sketches instead (``sketches.rank_error``), which cost by hours and not by rows or windows.
    """
    named = df.withColumn("reference_source", F.coalesce("reference_source", F.lit(NO_SOURCE))).withColumn("evaluation_mode", F.coalesce("evaluation_mode", F.lit(NO_MODE)))
    rows = named.withColumn("_place", F.coalesce("location_id", F.lit(""))).withColumn("_hour", F.date_trunc("hour", "target_time"))
    good = (F.col("status") == "EVALUATED") & finite(F.col("reference")) & finite(F.col("model_prediction")) & finite(F.col("persistence_prediction"))
    rows = rows.withColumn("_actual", F.when(good, F.col("reference"))).withColumn("_evaluated", F.col("status") == "EVALUATED")
    ends = rows.select(*GROUP, F.col("_hour").alias("target_time")).distinct()
    sums = {side: [s.alias(f"_{side}_{k}") for k, s in zip(SUMS, sufficient(prediction, "_actual"))] for side, prediction in (("model", "model_prediction"), ("persistence", "persistence_prediction"))}
    hourly = rows.groupBy(*GROUP, "_place", "_hour").agg(*sums["model"], *sums["persistence"], *_counts())
    parts = [c for c in hourly.columns if c not in (*GROUP, "_place", "_hour")]
    places = _reach(hourly, ends, window_hours).groupBy(*GROUP, "_place", "target_time").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts))

    own, base = (ratio(F.col(f"_{side}_abs_error"), F.col(f"_{side}_n")) for side in ("model", "persistence"))
    by = [*GROUP, "target_time", *(["_place"] if by_place else [])]
    out = places.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in parts),
        F.avg(own).alias("macro_location_mae"),
        F.count_if(own.isNotNull()).cast("int").alias("locations_evaluated"),
        F.count_if(F.col("evaluated_count") > 0).cast("int").alias("location_count"),
        F.count_if(own < base).cast("int").alias("locations_model_beats_persistence"),
        F.count_if(own >= base).cast("int").alias("locations_model_equals_or_trails_persistence"),
    )
    for side in ("model", "persistence"):
        renamed = out.withColumns({k: F.col(f"_{side}_{k}") for k in SUMS})
        out = renamed.withColumns(regression(f"{side}_")).drop(*SUMS)
    for kind in ("mae", "rmse"):
        gain = F.col(f"persistence_{kind}") - F.col(f"model_{kind}")
        out = out.withColumns({f"{kind}_improvement_c": gain, f"{kind}_improvement_pct": ratio(gain, F.col(f"persistence_{kind}")) * 100.0})
    complete = F.col("sample_count") == expected_samples
    out = out.withColumns({
        "mae_skill": 1.0 - ratio(F.col("model_mae"), F.col("persistence_mae")),
        "micro_global_mae": F.col("model_mae"),
        "sample_count": F.col("_model_n"),
        "expected_sample_count": F.lit(expected_samples).cast("long"),
        "expected_references": F.col("forecasts_total"),
        "missing_references": F.greatest(F.lit(0), F.col("forecasts_total") - F.col("received_references")),
        "reference_coverage_pct": ratio(F.col("received_references"), F.col("forecasts_total")) * 100.0,
        "evaluation_coverage_pct": ratio(F.col("evaluated_count"), F.col("forecasts_target_time_passed")) * 100.0,
        "expected_location_count": F.lit(expected_places).cast("int"),
    })
    out = out.withColumn("window_complete", complete if expected_places is None else complete & (F.col("location_count") == expected_places))
    out = out.withColumn("quality_status", quality_status(F.col("model_mae"), F.col("persistence_mae"), F.col("sample_count"), least))

    shown = ["reference", "model_prediction", "persistence_prediction", *columns]
    measured, wanted = rows.filter(good), [*LAGS, *shown]
    shapes = _distributions(measured, ends, by, wanted, window_hours) if sketch_k is None else _sketched(measured, ends, by, wanted, window_hours, sketch_k)
    out = out.join(shapes, by, "left")
    scope, place = ("LOCATION", F.col("_place")) if by_place else ("GLOBAL", F.lit(None).cast("string"))
    out = out.withColumns({f"{to}_{name}_seconds": F.col("_shapes")[lag][part] for lag, to in LAGS.items() for name, part in (("median", "p50"), ("p95", "p95"), ("max", "max"))})
    out = out.withColumns({
        "metric_version": F.lit(version),
        "metric_scope": F.lit(scope),
        "window_hours": F.lit(window_hours),
        "location_id": F.nullif(place, F.lit("")),
        "distribution_json": F.coalesce(F.to_json(F.map_filter("_shapes", lambda k, _: ~k.isin(*LAGS))), F.lit("{}")),
    })
    identity = (F.lit("FORECAST_METRIC"), F.col("metric_version"), *(F.col(c) for c in GROUP), F.col("metric_scope"), F.col("window_hours"), utc_text(F.col("target_time")), F.col("location_id"))
    out = out.withColumn("metric_id", stable_id(*identity)).drop("_place", "_shapes", *(c for c in out.columns if c.startswith(("_model_", "_persistence_"))))
    told = [c for c in sorted(out.columns) if c not in ("metric_id", "distribution_json")]
    return out.withColumn("metrics_json", F.to_json(F.struct(*told))).withColumn("computed_at", F.current_timestamp())
