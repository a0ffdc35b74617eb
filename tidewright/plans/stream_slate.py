"""Queries: streams run until drained, merges, and micro-batch scoring (§2.2, 2.10, 2.11, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import forecast_id
from ..functions.numbers import six
from ..operators import audit, features, quality, state, windows
from ..sources.merge import log_rows, merged, newest, without
from ..sources.readers import file_stream
from ..streaming import history
from ..streaming import medallion as runs
from .base import PANEL, load, observations, panel, query, s6, scratch, sec, seconds
from .medallion import RAW, VALID, raw

COLUMNS = ("event_id", "offset", "location_id", "event_time", "temperature_c", "humidity_pct", "precipitation_mm", "latitude", "longitude")


def arrivals(spark, d, folder: str, batches: int = 4, files: int = 2):
    """The raw records as a stream of files by ranges of offsets, so many files a micro-batch."""
    r = raw(spark, d).select(*COLUMNS)
    r.repartitionByRange(batches * files, "offset").write.parquet(f"{folder}/in")
    return file_stream(spark, f"{folder}/in", r.schema, files)


@query(f"WITH {RAW} SELECT DISTINCT event_id, location_id, temperature_c FROM raw WHERE {VALID}")
def stream_dedupe(spark, d):
    """STR-01/02/06/07/12, SRC-05/06, SNK-01: the watermark is wide, so no row is late."""
    folder = scratch(spark)
    queries = runs.silver(arrivals(spark, d, folder), quality.valid_observation(), folder, f"{folder}/state", "40 days")
    runs.drain(*queries)
    return spark.read.parquet(f"{folder}/silver").select("event_id", "location_id", "temperature_c")


@query(f"WITH {RAW} SELECT event_id, \"offset\" FROM raw WHERE {VALID} IS NOT TRUE")
def stream_dead_letters(spark, d):
    """STR-12: the other sink."""
    folder = scratch(spark)
    runs.drain(*runs.silver(arrivals(spark, d, folder, 2), quality.valid_observation(), folder, f"{folder}/state", "40 days"))
    return spark.read.parquet(f"{folder}/dead").select("event_id", "offset")


@query(f"WITH {RAW} SELECT {sec("date_trunc('hour', event_time)")} AS window_start, location_id, count(*) AS n, {s6('avg(temperature_c)')} AS mean FROM raw WHERE {VALID} GROUP BY ALL")
def stream_gold(spark, d):
    """STR-04/05, SNK-02: tumbling windows in update mode, upserted by key; after the drain the table equals a batch."""
    folder = scratch(spark)
    good = quality.split_valid(arrivals(spark, d, folder), quality.valid_observation())[0]
    gold = windows.windowed(good, "event_time", "1 hour", None, ["location_id"], windows.measures("temperature_c"), "40 days")
    shape = lambda rows: rows.select(seconds("window_start").alias("window_start"), "location_id", "n", six(F.col("mean")).alias("mean"))
    runs.drain(runs.upsert(gold, f"{folder}/gold", f"{folder}/state", shape=shape))
    return newest(spark, f"{folder}/gold", "window_start long, location_id string, n long, mean double", ["window_start", "location_id"])


@query(f"WITH {RAW} SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT DISTINCT event_id FROM raw WHERE {VALID})")
def stream_restart(spark, d):
    """STR-13: a second run from the same checkpoint adds nothing."""
    folder = scratch(spark)
    source = arrivals(spark, d, folder, 2)
    for _ in range(2):
        runs.drain(*runs.silver(source, quality.valid_observation(), folder, f"{folder}/state", "40 days"))
    return spark.read.parquet(f"{folder}/silver").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query(f"WITH {RAW}, g AS (SELECT count(*) AS n FROM raw WHERE {VALID}), l AS (SELECT count(*) AS n FROM raw WHERE {VALID} AND event_id % 10 = 0) SELECT g.n AS normal_generated, g.n AS normal_accepted, 0 AS normal_dropped, l.n AS late_generated, 0 AS late_accepted, l.n AS late_dropped, l.n AS total_dropped, 0 AS unexpected, 0 AS duplicate_keys, l.n > 0 AS conserved FROM g, l")
def stream_late_conservation(spark, d):
    """STR-08: normal rows come by time and all count; those sent again 60 days back in the last batch are all dropped."""
    folder = scratch(spark)
    good = raw(spark, d).select(*COLUMNS).filter(quality.valid_observation()).withColumn("fault", F.lit("NORMAL"))
    back = good.filter("event_id % 10 = 0").withColumns({"event_time": F.col("event_time") - F.expr("INTERVAL 60 DAYS"), "fault": F.lit("LATE")})
    first, second = (F.to_timestamp(F.lit(t)) for t in ("2024-01-11", "2024-01-21"))
    time = F.col("event_time")
    # files are read in the order of their times; rows are late by the watermark of the batch before the last
    for rows in (good.filter(time < first), good.filter(time.between(first, second)), good.filter(time > second).unionByName(back)):
        rows.repartition(2).write.mode("append").parquet(f"{folder}/in")
    source = file_stream(spark, f"{folder}/in", good.schema, 2)
    counted = windows.windowed(source, "event_time", "1 hour", None, ["location_id", "fault"], windows.measures("temperature_c"))
    runs.drain(runs.upsert(counted.select("window_start", "location_id", "fault", "n"), f"{folder}/gold", f"{folder}/state"))
    keys = ["window_start", "location_id", "fault"]
    gold = newest(spark, f"{folder}/gold", "window_start timestamp, location_id string, fault string, n long", keys)
    return audit.late_conservation(good.unionByName(back), gold, "fault", "n", keys)


def _orders(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")


OLD = "old AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0), new AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)"


def _merged(spark, d, mode, when=None):
    o = _orders(spark, d)
    new = o.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"))
    return merged(o.filter("o_orderkey % 2 = 0"), new, ["o_orderkey"], mode, when)


@query(f"WITH {OLD} SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM old o FULL OUTER JOIN new n USING (o_orderkey)")
def merge_upsert(spark, d):
    """SNK-02/06, CUS-1."""
    return _merged(spark, d, "upsert")


@query(f"WITH {OLD} SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def merge_insert_only(spark, d):
    """SNK-03, JON-18."""
    return _merged(spark, d, "insert_only")


@query(f"WITH {OLD} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL OR (n.o_orderkey IS NOT NULL AND o.o_orderstatus <> 'F') THEN n.o_totalprice ELSE o.o_totalprice END AS o_totalprice, CASE WHEN o.o_orderkey IS NULL OR (n.o_orderkey IS NOT NULL AND o.o_orderstatus <> 'F') THEN n.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus FROM old o FULL OUTER JOIN new n USING (o_orderkey)")
def merge_update_if(spark, d):
    """SNK-04: finished rows stay."""
    return _merged(spark, d, "update_if", F.col("t.o_orderstatus") != "F")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0")
def merge_delete(spark, d):
    """SNK-05."""
    o = _orders(spark, d)
    return without(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 5 = 0"), ["o_orderkey"])


@query("WITH k AS (SELECT CAST(event_type AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY ALL) SELECT k AS \"key\", n, true AS sorted FROM k")
def log_sink_rows(spark, d):
    """SNK-10, SRT-10: keys and JSON values as bytes; a key's rows are in order."""
    from pyspark.sql import Window

    rows = log_rows(observations(spark, d).select("location_id", "event_time", "event_id"), "location_id", "event_time", 3)
    placed = rows.select(F.col("key").cast("string").alias("key"), F.get_json_object(F.col("value").cast("string"), "$.event_time").alias("t"), F.monotonically_increasing_id().alias("i"))
    w = Window.partitionBy("key").orderBy("i")
    return placed.withColumn("back", F.col("t") < F.lag("t").over(w)).groupBy("key").agg(F.count("*").alias("n"), (F.count_if("back") == 0).alias("sorted"))


HOUR = "CAST(epoch(event_time) / 3600 AS BIGINT)"
SCORING = f"""st AS (SELECT location_id, event_time, temperature_c FROM panel WHERE event_time < TIMESTAMP '2024-01-20' AND {HOUR} % 11 <> 0),
b0 AS (SELECT location_id, event_time, CASE WHEN event_time < TIMESTAMP '2024-01-12' AND {HOUR} % 3 = 0 THEN temperature_c + 1 ELSE temperature_c END AS t FROM panel WHERE event_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11 23:00:00' OR event_time BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-21 23:00:00'),
b AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE {HOUR} % 5 = 0 UNION ALL SELECT location_id, event_time, t + 2 FROM b0 WHERE {HOUR} % 7 = 0),
k AS (SELECT location_id, event_time, count(*) AS n, count(DISTINCT t) AS v, min(t) AS t FROM b WHERE location_id <> 'view' GROUP BY ALL),
l AS (SELECT location_id, max(event_time) AS latest FROM st GROUP BY ALL),
j AS (SELECT k.*, s.temperature_c AS old, latest FROM k LEFT JOIN st s USING (location_id, event_time) LEFT JOIN l USING (location_id))"""


def _batch(spark, d):
    """A micro-batch with repeats, conflicts and late rows, the state that it meets and the known places (see the SQL)."""
    p = panel(spark, d).select("location_id", "event_time", "temperature_c", F.lit(10.0).alias("latitude"), F.lit(105.0).alias("longitude"))
    hour = F.floor(F.unix_seconds("event_time") / 3600)

    def between(first: str, last: str):
        return F.col("event_time").between(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last)))

    def shaped(rows):
        named = rows.withColumn("event_id", F.concat_ws("_", "location_id", hour)).withColumn("offset", F.lit(0))
        return named.withColumn("payload_hash", F.sha2(F.col("temperature_c").cast("string"), 256))

    stored = shaped(p.filter((F.col("event_time") < F.to_timestamp(F.lit("2024-01-20"))) & (hour % 11 != 0)))
    old = between("2024-01-10", "2024-01-11 23:00:00")
    changed = F.when(old & (hour % 3 == 0), F.col("temperature_c") + 1).otherwise(F.col("temperature_c"))
    b0 = p.filter(old | between("2024-01-20", "2024-01-21 23:00:00")).withColumn("temperature_c", changed)
    other = b0.filter(hour % 7 == 0).withColumn("temperature_c", F.col("temperature_c") + 2)
    batch = shaped(b0.unionByName(b0.filter(hour % 5 == 0)).unionByName(other))
    return batch, stored, p.select("location_id").distinct().filter("location_id <> 'view'")


@query(f"WITH {PANEL}, {SCORING} SELECT outcome, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'UNKNOWN_LOCATION' AS outcome, count(*) AS n FROM b WHERE location_id = 'view' UNION ALL SELECT 'DUPLICATE_CONFLICT', coalesce(sum(n), 0) FROM j WHERE v > 1 UNION ALL SELECT 'STATE_CONFLICT', count(*) FROM j WHERE v = 1 AND old <> t UNION ALL SELECT 'LATE_BEYOND_RETENTION', count(*) FROM j WHERE v = 1 AND old IS NULL AND event_time < latest - INTERVAL 48 HOUR UNION ALL SELECT 'ACCEPTED', count(*) FROM j WHERE v = 1 AND old IS NULL AND NOT coalesce(event_time < latest - INTERVAL 48 HOUR, false)) GROUP BY ALL HAVING sum(n) > 0")
def microbatch_classify(spark, d):
    """CMP-05, JON-03..06: what becomes of the rows of a batch."""
    batch, stored, known = _batch(spark, d)
    done = state.classify(batch, stored, known, ("temperature_c",))
    rejected = done.rejected.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n"))
    return rejected.unionByName(done.accepted.agg(F.lit("ACCEPTED").alias("outcome"), F.count("*").alias("n")))


class _Blend:
    def predict(self, frame):
        return 0.75 * frame["temperature_c"] + 0.25 * frame["temp_lag_1h"]


#: With a look-back of two hours: rows taken into the state, the history of their places, the hours they change.
OUTCOME = f"""a AS (SELECT location_id, event_time, t FROM j WHERE v = 1 AND old IS NULL AND NOT coalesce(event_time < latest - INTERVAL 48 HOUR, false)),
h AS (SELECT location_id, event_time, temperature_c AS t FROM st WHERE location_id IN (SELECT location_id FROM a) UNION ALL SELECT location_id, event_time, t FROM a),
c AS (SELECT DISTINCT h.location_id, h.event_time FROM h JOIN a ON h.location_id = a.location_id AND h.event_time BETWEEN a.event_time AND a.event_time + INTERVAL 2 HOUR),
hs AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY event_time) AS r, lag(t) OVER (PARTITION BY location_id ORDER BY event_time) AS before,
  count(*) OVER (PARTITION BY location_id ORDER BY {sec('event_time')} RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS seen FROM h),
judged AS (SELECT hs.*, CASE WHEN r <= 2 THEN 'INSUFFICIENT_HISTORY' WHEN seen < 3 THEN 'HISTORY_GAP' ELSE 'READY' END AS status FROM hs JOIN c USING (location_id, event_time)),
made AS (SELECT sha256('blend|' || location_id || '|' || strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') || '|1') AS forecast_id, *, location_id || '_' || {HOUR} AS source_event_id FROM judged WHERE status = 'READY')"""


def _outcome(spark, d):
    """The batch as a whole; forecasts of every fourth hour are there already."""
    batch, stored, known = _batch(spark, d)
    hour = F.floor(F.unix_seconds("event_time") / 3600)
    there = forecast_id(F.lit("blend"), F.col("location_id"), F.col("event_time"), F.lit(1))
    forecasts = panel(spark, d).filter(hour % 4 == 0).select(there.alias("forecast_id"))
    lag = {"temp_lag_1h": features.lagged(features.Panel())["temp_lag_1h"]}
    reads = ["temperature_c", "temp_lag_1h"]
    return state.run_batch(batch, stored, known, forecasts, ("temperature_c",), lag, reads, "blend", _Blend, depth=2)


@query(f"WITH {PANEL}, {SCORING}, {OUTCOME} SELECT location_id, {sec('event_time')} AS second, {s6('t')} AS temperature_c FROM a")
def microbatch_accepted(spark, d):
    """CMP-05: rows that a batch adds to the state."""
    done = _outcome(spark, d).batch.accepted
    return done.select("location_id", seconds("event_time").alias("second"), six(F.col("temperature_c")).alias("temperature_c"))


@query(f"WITH {PANEL}, {SCORING}, {OUTCOME} SELECT location_id, {sec('event_time')} AS second, status FROM judged")
def microbatch_statuses(spark, d):
    """CMP-05/06, WIN-09, STR-11: the hours that a batch changes, with the status of each."""
    return _outcome(spark, d).statuses.select("location_id", seconds("event_time").alias("second"), "status")


@query(f"WITH {PANEL}, {SCORING}, {OUTCOME} SELECT forecast_id, location_id, {sec('event_time')} AS second, {sec('event_time')} + 3600 AS target_second, source_event_id, {s6('0.75 * t + 0.25 * before')} AS prediction FROM made WHERE {HOUR} % 4 <> 0")
def microbatch_forecasts(spark, d):
    """CMP-05, JON-18, UDF-01/02: new forecasts of the hours that are ready."""
    made = _outcome(spark, d).forecasts
    times = [seconds("feature_time").alias("second"), seconds("target_time").alias("target_second")]
    return made.select("forecast_id", "location_id", *times, "source_event_id", six(F.col("prediction")).alias("prediction"))


@query(f"WITH {PANEL}, {SCORING}, {OUTCOME}, after AS (SELECT location_id, event_time FROM st UNION ALL SELECT location_id, event_time FROM a), top AS (SELECT location_id, max(event_time) AS latest FROM after GROUP BY ALL) SELECT location_id, {sec('event_time')} AS second FROM after JOIN top USING (location_id) WHERE event_time < top.latest - INTERVAL 48 HOUR")
def microbatch_expired(spark, d):
    """STR-10, SNK-05: keys of the state that expire with a batch."""
    return _outcome(spark, d).expired.select("location_id", seconds("event_time").alias("second"))


@query(f"""WITH {PANEL}, {SCORING}, {OUTCOME}, after AS (SELECT location_id, event_time FROM st UNION ALL SELECT location_id, event_time FROM a),
top AS (SELECT location_id, max(event_time) AS last FROM after GROUP BY ALL),
told AS (SELECT 'ACCEPTED' AS kind, location_id, event_time, CAST(NULL AS VARCHAR) AS outcome, t FROM a
  UNION ALL SELECT 'STATUS', location_id, event_time, status, t FROM judged
  UNION ALL SELECT 'EXPIRED', location_id, event_time, 'RETENTION', NULL FROM after JOIN top USING (location_id) WHERE event_time < top.last - INTERVAL 48 HOUR
  UNION ALL SELECT 'REJECTED', location_id, event_time, 'DUPLICATE_CONFLICT', NULL FROM b JOIN (SELECT location_id, event_time FROM j WHERE v > 1) USING (location_id, event_time)
  UNION ALL SELECT 'REJECTED', location_id, event_time, CASE WHEN old IS NULL THEN 'LATE_BEYOND_RETENTION' ELSE 'STATE_CONFLICT' END, NULL FROM j
    WHERE v = 1 AND (old <> t OR old IS NULL AND event_time < latest - INTERVAL 48 HOUR))
SELECT kind, location_id, {sec('event_time')} AS second, outcome, {s6('t')} AS temperature_c FROM told""")
def stream_history(spark, d):
    """CMP-05, STR-09/10/11: the batch as a stream over keyed state, stopped and started again between two halves of the places."""
    batch, stored, known = _batch(spark, d)
    folder = scratch(spark)
    half = F.crc32(F.col("location_id").cast("binary")) % 2
    source = file_stream(spark, f"{folder}/in/*", batch.schema)
    for k in range(2):
        batch.filter(half == k).write.parquet(f"{folder}/in/{k}")
        sound, _ = history.with_reason(source, known, ("temperature_c",))
        told = history.keyed_history(sound, ("temperature_c",), stored, depth=2)
        with history.state_store(spark, until_drained=True):
            runs.drain(runs.append(told, f"{folder}/told", f"{folder}/state"))
    told = spark.read.parquet(f"{folder}/told")
    return told.select("kind", F.col("key").alias("location_id"), "second", "outcome", six(F.col("temperature_c")).alias("temperature_c"))


@query(f"WITH {PANEL} SELECT location_id, {sec('event_time')} AS second, {s6('0.75 * temperature_c + 0.25 * before')} AS prediction FROM (SELECT *, lag(temperature_c) OVER (PARTITION BY location_id ORDER BY event_time) AS before FROM panel) WHERE before IS NOT NULL")
def model_scoring(spark, d):
    """UDF-01/02: predictions by Arrow batches from a model that each worker loads once."""
    lag = features.lagged(features.Panel())["temp_lag_1h"]
    ready = panel(spark, d).select("location_id", seconds("event_time").alias("second"), "temperature_c", lag.alias("temp_lag_1h")).filter("temp_lag_1h is not null")
    scored = state.score_batches(ready, ["temperature_c", "temp_lag_1h"], "blend", _Blend, ["location_id", "second"])
    return scored.select("location_id", "second", six(F.col("prediction")).alias("prediction"))
