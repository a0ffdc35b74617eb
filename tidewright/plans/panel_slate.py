"""Queries: the hourly panel and its features (§2.6, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..functions.numbers import six
from ..operators import audit, features
from .base import MEASURES, PANEL, load, panel, query, s6, scratch, sec, seconds

#: The test tables span one month and have gaps, so gates here look back a few hours.
SHORT = features.Panel(lags={c: (n, tuple(h for h in hs if h <= 6)) for c, (n, hs) in features.LAGS.items()}, roll_hours=(3, 6), depth=6)
SPLITS = (("TRAIN", None, "2024-01-15"), ("VALIDATION", "2024-01-15", "2024-01-22"), ("TEST", "2024-01-22", "2024-01-29"))
W = "WINDOW w AS (PARTITION BY location_id ORDER BY event_time)"


@query(f"WITH {PANEL} SELECT location_id, {sec('event_time')} AS second, {', '.join(MEASURES)} FROM panel")
def hourly_panel(spark, d):
    return panel(spark, d).select("location_id", seconds("event_time").alias("second"), *MEASURES)


GRID = "g AS (SELECT location_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS event_time FROM (SELECT location_id, min(event_time) AS lo, max(event_time) AS hi FROM panel GROUP BY ALL))"


@query(f"WITH {PANEL}, {GRID} SELECT g.location_id, {sec('g.event_time')} AS second, p.temperature_c FROM g LEFT JOIN panel p USING (location_id, event_time)")
def densify_grid(spark, d):
    """WIN-13."""
    return features.grid(panel(spark, d), "location_id", "event_time").select("location_id", seconds("event_time").alias("second"), "temperature_c")


@query(f"WITH {PANEL}, {GRID} SELECT location_id, {sec('event_time')} AS second FROM g ANTI JOIN panel p USING (location_id, event_time)")
def missing_hours(spark, d):
    """SET-07."""
    return features.missing_hours(panel(spark, d), "location_id", "event_time").select("location_id", seconds("event_time").alias("second"))


@query(f"WITH {PANEL}, {GRID}, m AS (SELECT location_id, {sec('event_time')} AS s FROM g ANTI JOIN panel p USING (location_id, event_time)), i AS (SELECT *, s - 3600 * row_number() OVER (PARTITION BY location_id ORDER BY s) AS island FROM m) SELECT location_id, min(s) AS gap_start, max(s) AS gap_end, count(*) AS gap_hours FROM i GROUP BY location_id, island")
def gap_islands(spark, d):
    """WIN-17."""
    g = features.gap_islands(panel(spark, d), "location_id", "event_time")
    return g.select("location_id", seconds("gap_start").alias("gap_start"), seconds("gap_end").alias("gap_end"), "gap_hours")


def _sql_lags() -> str:
    return ", ".join(f"lag({c}, {n}) OVER w AS {short}_lag_{n}h" for c, (short, ns) in features.LAGS.items() for n in ns)


@query(f"WITH {PANEL} SELECT location_id, {sec('event_time')} AS second, {_sql_lags()} FROM panel {W}")
def lag_features(spark, d):
    """WIN-01."""
    made = features.lagged(features.Panel())
    return panel(spark, d).select("location_id", seconds("event_time").alias("second"), *(v.alias(k) for k, v in made.items()))


def _sql_rolls() -> tuple[str, str]:
    parts, names = [], {"mean": "avg", "std": "stddev_pop", "sum": "sum"}
    for c, (short, operations) in features.ROLLS.items():
        for n in features.ROLL_HOURS:
            for op in operations:
                name = f"{short}_sum_{n}h" if op == "sum" else f"{short}_roll_{op}_{n}h"
                frame = f"OVER (PARTITION BY location_id ORDER BY event_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
                parts.append(f"{s6(f'CASE WHEN count({c}) {frame} = {n} THEN {names[op]}({c}) {frame} END')} AS {name}")
    return ", ".join(parts), ""


@query(f"WITH {PANEL} SELECT location_id, {sec('event_time')} AS second, {_sql_rolls()[0]} FROM panel")
def rolling_features(spark, d):
    """WIN-02/03."""
    made = features.rolled(features.Panel())
    return panel(spark, d).select("location_id", seconds("event_time").alias("second"), *(six(v).alias(k) for k, v in made.items()))


@query(f"WITH {PANEL} SELECT location_id, {sec('event_time')} AS second, " + ", ".join(f"{s6(f'{c} - lag({c}, {n}) OVER w')} AS {short}_delta_{n}h" for c, short, ns in features.DELTAS for n in ns) + f" FROM panel {W}")
def delta_features(spark, d):
    """WIN-04."""
    made = features.differences(features.Panel())
    return panel(spark, d).select("location_id", seconds("event_time").alias("second"), *(six(v).alias(k) for k, v in made.items()))


_PERIOD = {"hour": ("hour(l)", "24.0"), "day_of_week": ("(isodow(l) - 1)", "7.0"), "day_of_year": ("(dayofyear(l) - 1)", "365.25")}


@query(f"WITH {PANEL}, x AS (SELECT location_id, event_time, event_time + INTERVAL 7 HOUR AS l FROM panel) SELECT location_id, {sec('event_time')} AS second, CAST(hour(l) AS INTEGER) AS local_hour, CAST(isodow(l) - 1 AS INTEGER) AS local_day_of_week, CAST(month(l) AS INTEGER) AS local_month, CAST(dayofyear(l) AS INTEGER) AS local_day_of_year, " + ", ".join(f"{s6(f'{fn}({v}::DOUBLE * (2.0 * pi() / {p}))')} AS {n}_{fn}" for n, (v, p) in _PERIOD.items() for fn in ("sin", "cos")) + " FROM x")
def calendar_features(spark, d):
    """§2.9 calendar."""
    made = times.local_calendar(F.col("event_time"))
    return panel(spark, d).select("location_id", seconds("event_time").alias("second"), *((six(v) if k.endswith(("sin", "cos")) else v).alias(k) for k, v in made.items()))


GATE = "coalesce(lag(event_time, {n}) OVER w = event_time - INTERVAL {n} HOUR, false) AS history_complete, coalesce(lead(event_time) OVER w = event_time + INTERVAL 1 HOUR, false) AS target_complete"


@query(f"WITH {PANEL}, a AS (SELECT *, {GATE.format(n=24)} FROM panel {W}), b AS (SELECT *, {GATE.format(n=6)} FROM panel {W}) SELECT 24 AS depth, location_id, count(*) AS n, count(*) FILTER (history_complete AND target_complete) AS eligible FROM a GROUP BY location_id UNION ALL SELECT 6, location_id, count(*), count(*) FILTER (history_complete AND target_complete) FROM b GROUP BY location_id")
def label_gate(spark, d):
    """WIN-05/06 with the contract's look-back of 24 hours and a short one."""
    p, out = panel(spark, d), None
    for depth in (24, 6):
        gate = features.gates(features.Panel(depth=depth))
        counted = p.select("location_id", *(v.alias(k) for k, v in gate.items())).groupBy(F.lit(depth).alias("depth"), "location_id").agg(F.count("*").alias("n"), F.count_if(F.col("history_complete") & F.col("target_complete")).alias("eligible"))
        out = counted if out is None else out.unionByName(counted)
    return out


@query(f"WITH {PANEL}, s AS (SELECT location_id, event_time, lead(event_time) OVER w AS following FROM panel {W}) SELECT location_id, count(*) AS n, count(*) FILTER (following <> event_time + INTERVAL 1 HOUR) AS gap_edges FROM s GROUP BY location_id")
def gap_edges(spark, d):
    """WIN-07."""
    return features.gap_edges(panel(spark, d))



def _sql_split(target: str) -> str:
    return f"CASE WHEN {target} < TIMESTAMP '2024-01-15' THEN 'TRAIN' WHEN {target} < TIMESTAMP '2024-01-22' THEN 'VALIDATION' WHEN {target} < TIMESTAMP '2024-01-29' THEN 'TEST' END"


def _sql_frame(p: features.Panel) -> str:
    """CTEs up to ``frame``: the panel with all features, gates, label and split of every row."""
    lags = [f"lag({c}, {n}) OVER w AS {short}_lag_{n}h" for c, (short, ns) in p.lags.items() for n in ns]
    deltas = [f"{s6(f'{c} - lag({c}, {n}) OVER w')} AS {short}_delta_{n}h" for c, short, ns in p.deltas for n in ns]
    rolls, names = [], {"mean": "avg", "std": "stddev_pop", "sum": "sum"}
    for c, (short, operations) in p.rolls.items():
        for n in p.roll_hours:
            over = f"OVER (PARTITION BY location_id ORDER BY event_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            for op in operations:
                name = f"{short}_sum_{n}h" if op == "sum" else f"{short}_roll_{op}_{n}h"
                rolls.append(f"{s6(f'CASE WHEN count({c}) {over} = {n} THEN {names[op]}({c}) {over} END')} AS {name}")
    calendar = ["CAST(hour(l) AS INTEGER) AS local_hour", "CAST(isodow(l) - 1 AS INTEGER) AS local_day_of_week", "CAST(month(l) AS INTEGER) AS local_month", "CAST(dayofyear(l) AS INTEGER) AS local_day_of_year"]
    calendar += [f"{s6(f'{fn}({v}::DOUBLE * (2.0 * pi() / {period}))')} AS {n}_{fn}" for n, (v, period) in _PERIOD.items() for fn in ("sin", "cos")]
    made = ", ".join([*calendar, *lags, *rolls, *deltas])
    return f"""{PANEL}, placed AS (SELECT *, 21.0::DOUBLE AS latitude, 105.0::DOUBLE AS longitude, event_time + INTERVAL 7 HOUR AS l, event_time + INTERVAL 1 HOUR AS target_time FROM panel),
frame AS (SELECT *, {made}, {GATE.format(n=p.depth)}, lead(temperature_c) OVER w AS target_1h, {_sql_split('target_time')} AS split,
  lag(event_time) OVER w AS before, lead(event_time) OVER w AS after, lag(event_time, {p.depth}) OVER w AS history FROM placed {W})"""


def placed(spark, d):
    return panel(spark, d).withColumn("latitude", F.lit(21.0)).withColumn("longitude", F.lit(105.0))


def _sql_whole_frame(p: features.Panel) -> str:
    names = ", ".join(features.columns(p))
    return f"WITH {_sql_frame(p)} SELECT location_id, {sec('event_time')} AS second, {sec('target_time')} AS target_second, {names}, target_1h, split FROM frame WHERE history_complete AND target_complete"


def _whole_frame(spark, d, p):
    f = features.build(placed(spark, d), p, splits=SPLITS)
    made = {*features.rolled(p), *features.differences(p)}
    shown = [six(F.col(c)).alias(c) if c in made or c.endswith(("_sin", "_cos")) else F.col(c) for c in features.columns(p)]
    return f.select("location_id", seconds("event_time").alias("second"), seconds("target_time").alias("target_second"), *shown, "target_1h", "split")


@query(_sql_whole_frame(features.Panel()))
def feature_frame(spark, d):
    """CMP-01/02: all 73 features, label and split behind the gates of 24 hours."""
    return _whole_frame(spark, d, features.Panel())


@query(_sql_whole_frame(SHORT))
def feature_frame_6h(spark, d):
    """CMP-01/02 with a look-back of six hours, which more rows of a gappy panel have."""
    return _whole_frame(spark, d, SHORT)


def _sql_diagnostics(p: features.Panel) -> str:
    counts = {
        "source_rows": "true",
        "source_gap_edges": "before IS NOT NULL AND event_time <> before + INTERVAL 1 HOUR",
        "history_continuity_violations": "history IS NOT NULL AND NOT history_complete",
        "history_ineligible_rows": "NOT history_complete",
        "target_ineligible_rows": "NOT target_complete",
        "invalid_feature_rows": "history_complete AND target_complete AND pressure_hpa IS NULL",
        "eligible_rows": "history_complete AND target_complete AND pressure_hpa IS NOT NULL",
        "target_gap_edges": "after IS NOT NULL AND NOT target_complete",
    }
    return f"WITH {_sql_frame(p)} SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in counts.items()) + " FROM frame"


@query(_sql_diagnostics(features.Panel()))
def feature_diagnostics(spark, d):
    """CMP-01: the eight counts."""
    return features.diagnostics(placed(spark, d))


@query(f"WITH {PANEL}, s AS (SELECT location_id, event_time, {_sql_split('(event_time + INTERVAL 1 HOUR)')} AS split FROM panel) SELECT split, location_id, count(*) AS n, {sec('min(event_time)')} AS first_second, {sec('max(event_time)')} AS last_second FROM s GROUP BY ALL")
def temporal_split_counts(spark, d):
    """CMP-02, AGG-17."""
    target = F.col("event_time") + features.hours(1)
    s = panel(spark, d).withColumn("split", features.split_name(target, SPLITS))
    return s.groupBy("split", "location_id").agg(F.count("*").alias("n"), seconds(F.min("event_time")).alias("first_second"), seconds(F.max("event_time")).alias("last_second"))


@query(f"WITH {PANEL} SELECT a.location_id, {sec('a.event_time')} AS second, b.temperature_c AS label FROM panel a JOIN panel b ON a.location_id = b.location_id AND b.event_time = a.event_time + INTERVAL 2 HOUR")
def future_label_exact(spark, d):
    """JON-11."""
    return features.future_label(panel(spark, d), "location_id", "event_time", "temperature_c", 2).select("location_id", seconds("event_time").alias("second"), "label")


@query(f"WITH {PANEL}, l AS (SELECT location_id, event_time + INTERVAL 1 HOUR AS target_time, lead(temperature_c) OVER w AS label FROM panel {W}) SELECT count(*) AS labels, count(*) FILTER (p.temperature_c IS NULL) AS missing, count(*) FILTER (p.temperature_c <> l.label) AS \"different\" FROM l LEFT JOIN panel p ON p.location_id = l.location_id AND p.event_time = l.target_time")
def label_verify_join(spark, d):
    """JON-10: positional labels against the source at the target time, gaps left in to be found."""
    p = panel(spark, d)
    labels = p.select("location_id", (F.col("event_time") + features.hours(1)).alias("target_time"), F.lead("temperature_c").over(features.Panel().window).alias("label"))
    return features.label_faults(labels, p, "location_id", "event_time", "target_time", "label", "temperature_c")


@query(f"""WITH {PANEL}, faulty AS (SELECT location_id, event_time FROM panel UNION ALL SELECT location_id, event_time FROM panel WHERE CAST(epoch(event_time) / 3600 AS BIGINT) % 19 = 0
  UNION ALL SELECT location_id, event_time + INTERVAL 30 MINUTE FROM panel WHERE CAST(epoch(event_time) / 3600 AS BIGINT) % 23 = 0)
SELECT location_id, CAST(year(event_time) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT event_time) AS hours, count(*) - count(DISTINCT event_time) AS duplicates,
  count(*) FILTER (date_trunc('hour', event_time) <> event_time) AS off_grid,
  CAST((epoch(max(date_trunc('hour', event_time))) - epoch(min(date_trunc('hour', event_time)))) / 3600 + 1 - count(DISTINCT event_time) FILTER (date_trunc('hour', event_time) = event_time) AS BIGINT) AS missing_hours
FROM faulty GROUP BY ALL""")
def dataset_audit(spark, d):
    """CMP-16/17 over a panel with repeated hours and hours off the grid."""
    p = panel(spark, d).select("location_id", "event_time")
    hour = F.floor(F.unix_seconds("event_time") / 3600)
    off = p.filter(hour % 23 == 0).withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 30 MINUTES"))
    return audit.dataset(p.unionByName(p.filter(hour % 19 == 0)).unionByName(off), "location_id", "event_time")


@query(f"SELECT count(*) AS total_rows, count(DISTINCT ts) AS distinct_hours FROM (SELECT date_trunc('hour', ts) AS ts FROM events)")
def truncated_hours(spark, d):
    return load(spark, d, "events").select(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("total_rows"), F.countDistinct("h").alias("distinct_hours"))


@query("SELECT event_id, " + sec("date_trunc('hour', ts)") + " AS current_second, " + sec("date_trunc('hour', ts) - INTERVAL 1 HOUR") + " AS completed_second, " + sec("date_trunc('hour', ts) + INTERVAL 1 HOUR") + " AS target_second, date_trunc('hour', ts) + INTERVAL 1 HOUR > ts AS prospective FROM events")
def timing_contract(spark, d):
    """CMP-08 with a horizon of two hours after the last completed one."""
    t = times.timing(F.col("ts"), 2)
    return load(spark, d, "events").select("event_id", seconds(t["current_hour"]).alias("current_second"), seconds(t["completed_hour"]).alias("completed_second"), seconds(t["target_time"]).alias("target_second"), t["prospective"].alias("prospective"))


@query(f"WITH {PANEL} SELECT location_id, {sec('event_time')} AS second, temperature_c FROM panel WHERE event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-12' AND location_id IN ('view', 'click')")
def smoke_slice(spark, d):
    """FLT-08, SRT-01/03: a half-open range of some keys, newest first."""
    t = lambda s: F.to_timestamp(F.lit(s))
    p = panel(spark, d).filter((F.col("event_time") >= t("2024-01-10")) & (F.col("event_time") < t("2024-01-12")) & F.col("location_id").isin("view", "click"))
    return p.orderBy(F.col("event_time").desc(), "location_id").select("location_id", seconds("event_time").alias("second"), "temperature_c")


#: Faults planted into the second table that read_back_suite reads: labels, features, splits and repeated keys by hour.
_HOUR = "CAST(epoch(event_time) / 3600 AS BIGINT)"
_READ = {
    "has_rows": "count(there) > 0",
    "columns_as_agreed": "true",
    "keys_unique": "count(there) = count(DISTINCT (location_id, event_time)) FILTER (there)",
    "identities_present": "count(*) FILTER (there AND (location_id IS NULL OR event_time IS NULL OR target_time IS NULL)) = 0",
    "labels_present": "count(*) FILTER (there AND target_1h IS NULL) = 0",
    "splits_present": "count(*) FILTER (there AND split IS NULL) = 0",
    "splits_in_bounds": f"count(*) FILTER (there AND (split IS DISTINCT FROM {_sql_split('target_time')} OR split IS NULL)) = 0",
    "targets_aligned": "count(*) FILTER (target_time <> event_time + INTERVAL 1 HOUR) = 0",
    "labels_true": "count(*) FILTER (there AND (truth IS NULL OR truth <> target_1h)) = 0",
    "features_finite": "count(*) FILTER (there AND (isnan(temp_lag_1h) OR temp_lag_1h IS NULL)) = 0",
}
_FAULTS = f"""sound AS (SELECT location_id, event_time, target_time, temp_lag_1h, target_1h, split FROM frame WHERE history_complete AND target_complete),
faulty AS (SELECT location_id, event_time, target_time, CASE WHEN {_HOUR} % 13 = 0 THEN 'NaN'::DOUBLE ELSE temp_lag_1h END AS temp_lag_1h, CASE WHEN {_HOUR} % 17 = 0 THEN target_1h + 1 ELSE target_1h END AS target_1h,
  CASE WHEN {_HOUR} % 19 = 0 THEN 'TEST' ELSE split END AS split FROM sound UNION ALL SELECT * FROM sound WHERE {_HOUR} % 11 = 0),
both_ AS (SELECT 'sound' AS variant, * FROM sound UNION ALL SELECT 'faulty', * FROM faulty),
checked AS (SELECT b.*, true AS there, p.temperature_c AS truth FROM both_ b LEFT JOIN (SELECT location_id, event_time AS target_time, temperature_c FROM panel) p USING (location_id, target_time))"""


@query(f"WITH {_sql_frame(SHORT)}, {_FAULTS} " + " UNION ALL ".join(f"SELECT variant, '{name}' AS assertion, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS result FROM (VALUES ('sound'), ('faulty')) v(variant) LEFT JOIN checked USING (variant) GROUP BY variant" for name, ok in _READ.items()))
def read_back_suite(spark, d):
    """CMP-04: a feature table written, read back and held to its source; and one with planted faults."""
    p, hour, folder = placed(spark, d), F.floor(F.unix_seconds("event_time") / 3600), scratch(spark)
    sound = features.build(p, SHORT, splits=SPLITS)
    faulty = sound.withColumns({
        "temp_lag_1h": F.when(hour % 13 == 0, float("nan")).otherwise(F.col("temp_lag_1h")),
        "target_1h": F.when(hour % 17 == 0, F.col("target_1h") + 1).otherwise(F.col("target_1h")),
        "split": F.when(hour % 19 == 0, "TEST").otherwise(F.col("split")),
    })
    faulty = faulty.unionByName(sound.filter(hour % 11 == 0))
    out = None
    for name, frame in (("sound", sound), ("faulty", faulty)):
        frame.write.parquet(f"{folder}/{name}")
        back = audit.read_back(spark.read.parquet(f"{folder}/{name}"), p, "location_id", "event_time", "target_1h", "temperature_c", features.columns(SHORT), splits=SPLITS)
        back = back.select(F.lit(name).alias("variant"), "assertion", "result")
        out = back if out is None else out.unionByName(back)
    return out


@query(f"WITH {PANEL}, x AS (SELECT event_time < TIMESTAMP '2024-01-15' AS train, temperature_c AS v FROM panel), a AS (SELECT count(v) AS n, avg(v) AS m, stddev_pop(v) AS s FROM x WHERE train), b AS (SELECT count(v) AS n, avg(v) AS m FROM x WHERE NOT train) SELECT 'temperature_c' AS \"column\", a.n AS train_count, b.n AS live_count, {s6('(b.m - a.m) / nullif(a.s, 0)')} AS mean_shift FROM a, b")
def distribution_shift(spark, d):
    """CMP-29."""
    p, cut = panel(spark, d), F.to_timestamp(F.lit("2024-01-15"))
    s = audit.shift(p.filter(F.col("event_time") < cut), p.filter(F.col("event_time") >= cut), ["temperature_c"])
    return s.select("column", "train_count", "live_count", six(F.col("mean_shift")).alias("mean_shift"))
