"""Queries: forecast errors, distributions, roll-ups and the status machine (§2.5, 2.6, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.numbers import six
from ..operators import evaluate, metrics, model, sketches
from .base import OBS, PANEL, SCORED, observations, panel, query, s6, scored, scratch, sec, seconds

MODEL, BASE = "model_prediction", "persistence_prediction"


def _reg(p: str, by: str = "", where: str = "") -> str:
    e = f"({p} - reference)"
    r2 = f"CASE WHEN count(*) >= 2 AND var_pop(reference) > 0 THEN 1 - sum({e} * {e}) / (var_pop(reference) * count(*)) END"
    return f"{s6(f'avg(abs({e}))')} AS mae, {s6(f'sqrt(avg({e} * {e}))')} AS rmse, {s6(f'avg({e})')} AS bias, {s6(r2)} AS r2"


def _show(df, *exact):
    return df.select(*exact, *(six(F.col(c)).alias(c) for c in ("mae", "rmse", "bias", "r2")))


@query(f"WITH {SCORED} SELECT location_id, count(*) AS n, {_reg(MODEL)} FROM scored GROUP BY ALL")
def regression_metrics(spark, d):
    """AGG-18."""
    g = scored(spark, d).groupBy("location_id").agg(*metrics.sufficient(MODEL))
    return _show(g.select("location_id", "n", *(v.alias(k) for k, v in metrics.regression().items())), "location_id", "n")


def _summary_sql(by: str) -> str:
    mae = lambda p: f"avg(abs({p} - reference))"
    return f"SELECT {by}, count(*) AS sample_count, {s6(mae(MODEL))} AS model_mae, {s6(mae(BASE))} AS persistence_mae, {s6(f'{mae(BASE)} - {mae(MODEL)}')} AS mae_improvement, {s6(f'1 - {mae(MODEL)} / nullif({mae(BASE)}, 0)')} AS mae_skill, CASE WHEN count(*) < 100 THEN 'INSUFFICIENT_SAMPLE' WHEN {mae(MODEL)} < {mae(BASE)} THEN 'MODEL_BEATS_PERSISTENCE' WHEN {mae(MODEL)} > {mae(BASE)} THEN 'MODEL_TRAILS_PERSISTENCE' ELSE 'MODEL_EQUALS_PERSISTENCE' END AS quality_status FROM scored GROUP BY ALL"


@query(f"WITH {SCORED} {_summary_sql('location_id')}")
def skill_metrics(spark, d):
    """AGG-19, CMP-13/14."""
    s = metrics.evaluation_summary(scored(spark, d), ["location_id"], least=100)
    return s.select("location_id", "sample_count", *(six(F.col(c)).alias(c) for c in ("model_mae", "persistence_mae", "mae_improvement", "mae_skill")), "quality_status")


@query(f"WITH {SCORED}, k AS (SELECT location_id, count(*) AS n, avg(abs({MODEL} - reference)) AS m, avg(abs({BASE} - reference)) AS p FROM scored GROUP BY ALL) SELECT {s6('sum(m * n) / sum(n)')} AS micro_mae, {s6('avg(m)')} AS macro_mae, count(*) AS keys, count(*) FILTER (m < p) AS keys_beating, count(*) FILTER (NOT m < p) AS keys_not_beating FROM k")
def micro_macro(spark, d):
    """AGG-20."""
    one = metrics.micro_macro(metrics.evaluation_summary(scored(spark, d), ["location_id"]))
    return one.select(six(F.col("micro_mae")).alias("micro_mae"), six(F.col("macro_mae")).alias("macro_mae"), "keys", "keys_beating", "keys_not_beating")


@query(f"WITH {SCORED}, k AS (SELECT location_id, avg(abs({MODEL} - reference)) AS m, avg(abs({BASE} - reference)) AS p FROM scored GROUP BY ALL) SELECT location_id, {s6('m')} AS model_mae, CASE WHEN p - m > 1e-12 THEN 'improved' WHEN p - m < -1e-12 THEN 'worse' ELSE 'tied' END AS verdict FROM k ORDER BY m DESC, location_id LIMIT 3")
def per_key_metrics_topk(spark, d):
    """AGG-21, SRT-06."""
    return metrics.worst(metrics.evaluation_summary(scored(spark, d), ["location_id"]), "location_id", 3).select("location_id", six(F.col("model_mae")).alias("model_mae"), "verdict")


@query(f"WITH {SCORED}, t AS (SELECT *, hour(event_time) AS h, month(event_time) AS mo, year(event_time) AS y FROM scored) SELECT CASE WHEN grouping(h) = 0 THEN 'hour' WHEN grouping(mo) = 0 THEN 'month' ELSE 'year' END AS part, CAST(coalesce(h, mo, y) AS INTEGER) AS value, count(*) AS n, {_reg(MODEL)} FROM t GROUP BY GROUPING SETS ((h), (mo), (y))")
def temporal_breakdown(spark, d):
    """AGG-22."""
    return _show(metrics.temporal(scored(spark, d), "event_time"), "part", "value", "n")


def _roll(hours: int, by: str) -> str:
    """Sums over the rows of the trailing hours, joined by time and not by frame."""
    return f"SELECT h.location_id, {sec('h.event_time')} AS second, count(s.reference) AS n, {_reg(MODEL).replace('count(*)', 'count(s.reference)')} FROM h LEFT JOIN scored s ON s.location_id = h.location_id AND s.event_time BETWEEN h.event_time - INTERVAL {hours - 1} HOUR AND h.event_time GROUP BY ALL"


@query(f"WITH {SCORED}, h AS (SELECT DISTINCT location_id, event_time FROM scored) {_roll(24, '')}")
def rolling_24h_metrics(spark, d):
    """WIN-15, AGG-24."""
    hourly = metrics.hourly_sums(scored(spark, d), ["location_id"], "event_time", MODEL, "reference")
    return _show(metrics.rolling(hourly, ["location_id"], 24).withColumn("second", seconds("hour")), "location_id", "second", "n")


@query(f"WITH {SCORED}, k AS (SELECT DISTINCT location_id FROM scored UNION ALL SELECT 'never seen'), h AS (SELECT location_id, event_time FROM k, (SELECT DISTINCT event_time FROM scored)) {_roll(168, '')}")
def rolling_168h_location(spark, d):
    """WIN-16: every known location at every observed hour, one that never reports included."""
    s = scored(spark, d)
    known = s.select("location_id").distinct().unionByName(spark.createDataFrame([("never seen",)], "location_id string"))
    hourly = metrics.hourly_sums(s, ["location_id"], "event_time", MODEL, "reference")
    return _show(metrics.rolling_by_key(hourly, known, "location_id", 168).withColumn("second", seconds("hour")), "location_id", "second", "n")


_DIST = f"count(v) AS \"count\", {s6('avg(v)')} AS mean, {s6('stddev_pop(v)')} AS std, min(v) AS min, {s6('quantile_cont(v, 0.05)')} AS p05, {s6('quantile_cont(v, 0.5)')} AS p50, {s6('quantile_cont(v, 0.95)')} AS p95, max(v) AS max"


@query(f"WITH {OBS}, l AS (SELECT location_id, 'temperature_c' AS c, CASE WHEN event_id % 50 <> 0 THEN temperature_c END AS v FROM obs UNION ALL SELECT location_id, 'humidity_pct', humidity_pct FROM obs) SELECT location_id, c AS \"column\", {_DIST} FROM l GROUP BY ALL")
def distribution_summary(spark, d):
    """AGG-12/13: NaN left out."""
    o = observations(spark, d).withColumn("temperature_c", F.when(F.col("event_id") % 50 != 0, F.col("temperature_c")).otherwise(float("nan")))
    s = metrics.distributions(o, ["temperature_c", "humidity_pct"], ["location_id"])
    return s.select("location_id", "column", "count", *(six(F.col(c)).alias(c) for c in ("mean", "std")), "min", *(six(F.col(c)).alias(c) for c in ("p05", "p50", "p95")), "max")


@query(f"WITH {OBS} SELECT location_id, {s6('quantile_cont(temperature_c, 0.25)')} AS p25, {s6('quantile_cont(temperature_c, 0.99)')} AS p99 FROM obs GROUP BY ALL")
def percentiles_exact(spark, d):
    """AGG-10."""
    p = numbers.percentile_linear(F.col("temperature_c"), 0.25, 0.99)
    return observations(spark, d).groupBy("location_id").agg(six(p[0]).alias("p25"), six(p[1]).alias("p99"))


@query(f"WITH {OBS}, r AS (SELECT location_id, temperature_c AS v, row_number() OVER (PARTITION BY location_id ORDER BY temperature_c) - 1 AS i, count(*) OVER (PARTITION BY location_id) AS n FROM obs) SELECT location_id, v AS value FROM r WHERE i = floor((n - 1) * 0.95 + 0.5)")
def percentile_nearest_rank(spark, d):
    """AGG-11."""
    return metrics.nearest_rank(observations(spark, d), "temperature_c", 0.95, ["location_id"])


@query(f"WITH {OBS}, x AS (SELECT temperature_c AS v FROM obs), n AS (SELECT *, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM x WHERE v IS NOT NULL) SELECT {s6('(SELECT quantile_cont(v, 0.05) FROM x)')} AS p05, {s6('(SELECT quantile_cont(v, 0.5) FROM x)')} AS p50, {s6('(SELECT quantile_cont(v, 0.95) FROM x)')} AS p95, (SELECT v FROM n WHERE i = floor((n - 1) * 0.95 + 0.5)) AS nearest_p95")
def percentiles_of_all_rows(spark, d):
    """AGG-10/11 of one group of all rows, which no task sees whole."""
    o = observations(spark, d).select("temperature_c")
    p = metrics.percentiles(o, "temperature_c", [0.05, 0.5, 0.95]).select(*(six(F.col("percentiles")[i]).alias(n) for i, n in enumerate(("p05", "p50", "p95"))))
    return p.join(metrics.nearest_rank(o, "temperature_c", 0.95).select(F.col("value").alias("nearest_p95")))  # single rows


SHARES = (0.5, 0.95, 0.99)


@query(f"WITH {OBS} SELECT location_id, share, count(temperature_c) AS n, true AS within FROM obs, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) s(share) WHERE temperature_c IS NOT NULL GROUP BY ALL")
def percentile_approx_lag(spark, d):
    """AGG-09: whether each sketched percentile has the rank that it should have, within 1 / accuracy; SQL says that it has."""
    rows = observations(spark, d).select("location_id", "temperature_c").filter("temperature_c is not null")
    p = numbers.percentile_approx(F.col("temperature_c"), *SHARES)
    shares = F.array(*map(F.lit, SHARES))
    found = rows.groupBy("location_id").agg(p.alias("p")).select("location_id", F.inline(F.arrays_zip(shares.alias("share"), F.col("p").alias("quantile"))))
    met = sketches.ranks(rows, ["location_id"], "temperature_c", found)
    return met.select("location_id", "share", "n", sketches.within(1e-4).alias("within"))


def _windows_sql(span: int) -> str:
    return f"""SELECT {span} AS span, e.location_id, e.hour * 3600 AS second, share, count(*) AS n, true AS within FROM ends e JOIN v ON e.location_id = v.location_id AND v.hour BETWEEN e.hour - {span - 1} AND e.hour,
  (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) s(share) GROUP BY ALL"""


@query(f"""WITH {OBS}, v AS (SELECT l AS location_id, CAST(floor(epoch(event_time) / 3600) AS BIGINT) AS hour FROM (SELECT unnest(['all', location_id]) AS l, event_time FROM obs WHERE temperature_c IS NOT NULL)),
ends AS (SELECT DISTINCT location_id, hour FROM v) {' UNION ALL '.join(_windows_sql(n) for n in (24, 168))}""")
def sketch_window_ranks(spark, d):
    """AGG-09, CMP-13: quantiles of the last 24 and 168 hours, for each place and for all, from merged sketches; their exact ranks."""
    rows = observations(spark, d).filter("temperature_c is not null").select(F.explode(F.array(F.lit("all"), "location_id")).alias("location_id"), "event_time", "temperature_c")
    by, cells = ["location_id"], [F.struct(F.lit(s).alias("share"), sketches.quantile(s).alias("quantile")) for s in (0.05, 0.5, 0.95)]
    hours = sketches.hourly(rows, by, "event_time", "temperature_c", k=200)
    merged, ends, found = sketches.blocks(hours, by, 168, k=200), hours.select("location_id", F.col("hour").alias("end")), None
    for span in (24, 168):
        told = sketches.windows(merged, by, ends, span, k=200).select("location_id", "end", F.lit(span).alias("span"), F.inline(F.array(*cells)))
        found = told if found is None else found.unionByName(told)
    met = sketches.window_ranks(rows, by, "event_time", "temperature_c", found)
    return met.select("span", "location_id", (F.col("end") * 3600).alias("second"), "share", "n", sketches.within(3 * sketches.rank_error(200)).alias("within"))


H = "CAST(epoch(event_time) / 3600 AS BIGINT)"
SECOND = "CAST(floor(epoch(event_time)) AS BIGINT)"
#: Forecasts with faults by hour: places, predictions, events, horizons, times off the hour, ids, digests, inference times.
FORECASTS = f"""forecasts AS (SELECT CASE WHEN {H} % 53 = 0 THEN 'X|' ELSE 'F|' END || location_id || '|' || {SECOND} AS forecast_id,
  CASE WHEN {H} % 31 = 0 THEN 'nowhere' ELSE location_id END AS location_id,
  CASE WHEN {H} % 47 = 0 THEN event_time + INTERVAL 5 MINUTE ELSE event_time END AS feature_time,
  CASE WHEN {H} % 43 = 0 THEN event_time + INTERVAL 5 HOUR ELSE event_time + INTERVAL 1 HOUR END AS target_time,
  CASE WHEN {H} % 37 = 0 THEN NULL WHEN {H} % 41 = 0 THEN 'Infinity'::DOUBLE ELSE temperature_c + 0.5 END AS prediction,
  CASE WHEN {H} % 29 <> 0 THEN 'O|' || location_id || '|' || {SECOND} END AS source_event_id, {H} % 59 = 0 AS other_model, {H} % 61 = 0 AS no_inference, {H} % 53 = 0 AS other_id FROM panel)"""
REFS = f"""refs AS (SELECT location_id, event_time, temperature_c AS value, 'O|' || location_id || '|' || {SECOND} AS event_id, {H} % 23 = 0 AS conflict, {H} % 3 = 0 AS backfill FROM panel)"""
CONTRACT = {"model_sha256": "agreed"}


def forecasts(spark, d):
    """Forecasts of the panel's next hour with faults by hour (see the SQL)."""
    hour, second, minutes = F.floor(F.unix_seconds("event_time") / 3600), F.unix_seconds("event_time").cast("string"), lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))
    return panel(spark, d).select(
        F.concat_ws("|", F.when(hour % 53 == 0, "X").otherwise("F"), "location_id", second).alias("forecast_id"),
        F.when(hour % 31 == 0, "nowhere").otherwise(F.col("location_id")).alias("location_id"),
        (F.col("event_time") + F.when(hour % 47 == 0, minutes(5)).otherwise(minutes(0))).alias("feature_time"),
        (F.col("event_time") + F.when(hour % 43 == 0, minutes(300)).otherwise(minutes(60))).alias("target_time"),
        F.when(hour % 37 == 0, None).when(hour % 41 == 0, float("inf")).otherwise(F.col("temperature_c") + 0.5).alias("prediction"),
        F.when(hour % 29 != 0, F.concat_ws("|", F.lit("O"), "location_id", second)).alias("source_event_id"),
        F.when(hour % 59 == 0, "another").otherwise("agreed").alias("model_sha256"),
        F.when(hour % 61 != 0, F.col("event_time") + minutes(1)).alias("inference_time"),
        F.lit("LIVE_PROSPECTIVE").alias("execution_origin"),
    )


def references(spark, d):
    """The panel as archived observations; those of every 23rd hour come twice and differ."""
    hour = F.floor(F.unix_seconds("event_time") / 3600)
    p = panel(spark, d).select(F.lit("LIVE").alias("source"), "location_id", "event_time", F.concat_ws("|", F.lit("O"), "location_id", F.unix_seconds("event_time").cast("string")).alias("event_id"), F.col("temperature_c").cast("string").alias("payload"), F.col("temperature_c").alias("value"), (F.col("event_time") + F.expr("INTERVAL 3 MINUTES")).alias("ingestion_time"), F.when(hour % 3 == 0, "LIVE_SOURCE_BACKFILL").alias("retrieval_mode"))
    again = p.filter(hour % 23 == 0).withColumn("payload", F.lit("revised")).withColumn("ingestion_time", F.col("ingestion_time") + F.expr("INTERVAL 1 MINUTE"))
    return p.unionByName(again)


NOW = "2024-01-25 00:00:00"


def evaluated(spark, d):
    p = panel(spark, d)
    place = F.element_at(F.split("forecast_id", r"\|"), 2)  # unknown places keep the id of the place they stand for
    expected = F.concat_ws("|", F.lit("F"), place, F.unix_seconds("feature_time").cast("string"))
    return evaluate.evaluate(forecasts(spark, d), references(spark, d), p.select("location_id"), F.to_timestamp(F.lit(NOW)), expected_id=expected, contract=CONTRACT)


EVALUATED = f"""ck AS (SELECT *, date_trunc('hour', feature_time) = feature_time AND date_trunc('hour', target_time) = target_time AS whole FROM forecasts),
er AS (SELECT *, array_to_string(list_sort(list_filter([CASE WHEN location_id = 'nowhere' THEN 'UNKNOWN_LOCATION' END, CASE WHEN NOT whole THEN 'INVALID_FORECAST_TIME' END,
  CASE WHEN whole AND target_time <> feature_time + INTERVAL 1 HOUR THEN 'INVALID_FORECAST_HORIZON' END, CASE WHEN whole AND other_id THEN 'INVALID_FORECAST_ID' END,
  CASE WHEN prediction IS NULL OR isinf(prediction) THEN 'INVALID_PREDICTION' END, CASE WHEN other_model THEN 'UNSUPPORTED_MODEL_SHA256' END, CASE WHEN no_inference THEN 'INVALID_INFERENCE_TIME' END], lambda x: x IS NOT NULL)), ';') AS errors FROM ck),
ev AS (SELECT f.forecast_id, f.location_id, f.target_time, CASE
  WHEN errors <> '' THEN 'INVALID_PROVENANCE' WHEN a.event_id IS NULL THEN 'PENDING_BASELINE' WHEN a.conflict THEN 'REFERENCE_CONFLICT'
  WHEN f.target_time > TIMESTAMP '{NOW}' THEN 'PENDING_TARGET_TIME' WHEN b.conflict THEN 'REFERENCE_CONFLICT' WHEN b.event_id IS NULL THEN 'PENDING_REFERENCE' ELSE 'EVALUATED' END AS status,
  CASE WHEN errors <> '' THEN errors
  WHEN a.event_id IS NULL AND f.source_event_id IS NULL THEN 'SOURCE_EVENT_ID_MISSING' WHEN a.event_id IS NULL THEN 'FEATURE_TIME_REFERENCE_MISSING_OR_AMBIGUOUS' WHEN a.conflict THEN 'FEATURE_TIME_REFERENCE_REVISION_DETECTED'
  WHEN f.target_time <= TIMESTAMP '{NOW}' AND b.conflict THEN 'TARGET_TIME_REFERENCE_REVISION_DETECTED' END AS invalid_reason,
  f.target_time <= TIMESTAMP '{NOW}' AS target_time_passed, f.prediction - b.value AS model_error, a.value - b.value AS persistence_error,
  b.event_id IS NOT NULL AND a.event_id IS NOT NULL AND NOT a.conflict AND errors = '' AND f.target_time <= TIMESTAMP '{NOW}' AS received,
  CASE WHEN errors <> '' OR a.event_id IS NULL THEN 'UNCLASSIFIED' WHEN b.backfill THEN 'LIVE_SOURCE_BACKFILL' ELSE 'LIVE_PROSPECTIVE' END AS evaluation_mode
  FROM er f LEFT JOIN refs a ON a.location_id = f.location_id AND a.event_time = f.feature_time AND a.event_id = f.source_event_id
  LEFT JOIN refs b ON b.location_id = f.location_id AND b.event_time = f.target_time AND a.event_id IS NOT NULL)"""


@query(f"WITH {PANEL}, {FORECASTS}, {REFS}, {EVALUATED} SELECT forecast_id, status, invalid_reason, target_time_passed, evaluation_mode, CASE WHEN status = 'EVALUATED' THEN {s6('model_error')} END AS model_error, CASE WHEN status = 'EVALUATED' THEN {s6('persistence_error')} END AS persistence_error FROM ev")
def eval_status_machine(spark, d):
    """CMP-10/11/12, FLT-10, JON-12/13/14."""
    e = evaluated(spark, d)
    return e.select("forecast_id", "status", "invalid_reason", "target_time_passed", "evaluation_mode", six(F.col("model_error")).alias("model_error"), six(F.col("persistence_error")).alias("persistence_error"))


@query(f"WITH {PANEL}, {FORECASTS}, {REFS}, {EVALUATED} SELECT location_id, count(*) AS forecasts_total, count(*) FILTER (target_time_passed) AS forecasts_target_time_passed, count(*) FILTER (status = 'EVALUATED') AS evaluated_count, count(*) FILTER (status IN ('PENDING_REFERENCE', 'PENDING_BASELINE')) AS pending_reference_count, count(*) FILTER (received) AS received_references, {s6("100 * count(*) FILTER (status = 'EVALUATED') / nullif(count(*) FILTER (target_time_passed), 0)::DOUBLE")} AS evaluation_coverage_pct FROM ev GROUP BY ALL")
def coverage_counts(spark, d):
    """AGG-23."""
    c = metrics.coverage(evaluated(spark, d), ["location_id"])
    return c.select("location_id", "forecasts_total", "forecasts_target_time_passed", "evaluated_count", "pending_reference_count", "received_references", six(F.col("evaluation_coverage_pct")).alias("evaluation_coverage_pct"))


@query(f"WITH {PANEL}, {REFS} SELECT location_id, {sec('event_time')} AS second, event_id FROM refs WHERE conflict")
def revisions(spark, d):
    """CMP-09: hours whose archived payloads differ."""
    r = evaluate.references(references(spark, d))
    return r.filter("conflict").select("location_id", seconds("event_time").alias("second"), "event_id")


@query(f"WITH {OBS} SELECT location_id, {s6('regr_slope(temperature_c, humidity_pct)')} AS slope FROM obs GROUP BY ALL")
def lag_slope(spark, d):
    """AGG-25."""
    return observations(spark, d).groupBy("location_id").agg(six(metrics.slope("humidity_pct", "temperature_c")).alias("slope"))


@query(f"WITH {SCORED} SELECT {s6(f'avg(abs({BASE} - reference))')} AS mae FROM scored")
def persistence_baseline(spark, d):
    """CMP-27."""
    s = model.persistence(scored(spark, d), BASE, "guess")
    return s.agg(six(F.avg(F.abs(F.col("guess") - F.col("reference")))).alias("mae"))


NAMES = [BASE, "before", "hour"]
CANDIDATES = [model.Candidate("small", 3, 2), model.Candidate("large", 5, 3)]


def _labelled(spark, d):
    """Rows with features and label, and by time TRAIN, VALIDATION and TEST."""
    from pyspark.sql import Window

    w = Window.partitionBy("location_id").orderBy("event_time")
    rows = scored(spark, d).withColumn("before", F.lag(BASE).over(w)).withColumn("hour", F.hour("event_time")).filter("before is not null")
    first, second = (F.to_timestamp(F.lit(t)) for t in ("2024-01-16", "2024-01-21"))
    time = F.col("event_time")
    return rows.filter(time < first), rows.filter((time >= first) & (time < second)), rows.filter(time >= second)


@query()
def model_search(spark, d):
    """CMP-28, SRT-07: gradient-boosted trees on the first days, ranked on later ones; not equal to other libraries' trees."""
    train, valid, _ = _labelled(spark, d)
    return model.ranked(model.search(train, valid, NAMES, "reference", CANDIDATES)[2])


@query()
def model_frozen(spark, d):
    """CMP-28/31: the winner frozen by a digest before TEST is read, refitted, saved, read back and then tested once."""
    return model.frozen(*_labelled(spark, d), NAMES, "reference", CANDIDATES, scratch(spark))
