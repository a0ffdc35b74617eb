"""Queries: raw records, validity, duplicates, windows (§2.3, 2.5, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.numbers import finite, six
from ..operators import audit, dedupe, faults, quality, windows
from .base import OBS, load, observations, query, s6, sec, seconds

VALID = "(event_id IS NOT NULL AND location_id IS NOT NULL AND event_time IS NOT NULL AND temperature_c BETWEEN -90 AND 60 AND humidity_pct BETWEEN 0 AND 100 AND precipitation_mm >= 0 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)"


def raw(spark, d):
    """Observations as log records: every 97th is repeated, every 89th is too hot, every 101st lacks its key."""
    o = observations(spark, d)
    bad = o.withColumn("temperature_c", F.when(F.col("event_id") % 89 == 0, 999.0).otherwise(F.col("temperature_c"))).withColumn("location_id", F.when(F.col("event_id") % 101 != 0, F.col("location_id")))
    copies = F.when(F.col("event_id") % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return bad.withColumn("copy", F.explode(copies)).withColumn("offset", F.col("event_id") * 2 + F.col("copy")).withColumn("partition", (F.col("event_id") % 4).cast("int"))


RAW = OBS + """, raw AS (SELECT o.* REPLACE (CASE WHEN event_id % 89 = 0 THEN 999.0::DOUBLE ELSE temperature_c END AS temperature_c, CASE WHEN event_id % 101 <> 0 THEN location_id END AS location_id), copy,
  event_id * 2 + copy AS "offset", CAST(event_id % 4 AS INTEGER) AS "partition" FROM obs o, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR event_id % 97 = 0)"""


@query("SELECT CAST(event_id AS VARCHAR) AS message_key, props AS payload, 'events' AS topic, CAST(event_id % 4 AS INTEGER) AS \"partition\", event_id AS \"offset\", " + sec("ts") + " AS kafka_second FROM events")
def bronze_projection(spark, d):
    """PRJ-01, SRC-07."""
    return load(spark, d, "events").select(F.col("event_id").cast("string").alias("message_key"), F.col("props").alias("payload"), F.lit("events").alias("topic"), (F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), seconds("ts").alias("kafka_second"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def json_extract_props(spark, d):
    """PRJ-02 and the JSON functions: a parsed struct beside a path."""
    e = load(spark, d, "events").withColumn("data", F.from_json("props", "k long"))
    return e.select("event_id", "data.*", F.get_json_object("props", "$.absent").alias("absent"))


@query(f"WITH {RAW} SELECT event_id, \"offset\", location_id, temperature_c FROM raw WHERE {VALID}")
def silver_valid(spark, d):
    """FLT-01/02."""
    return quality.split_valid(raw(spark, d), quality.valid_observation())[0].select("event_id", "offset", "location_id", "temperature_c")


@query(f"WITH {RAW} SELECT event_id, \"offset\", location_id, temperature_c FROM raw WHERE {VALID} IS NOT TRUE")
def silver_dlq(spark, d):
    """FLT-02: null validity is invalid."""
    return quality.split_valid(raw(spark, d), quality.valid_observation())[1].select("event_id", "offset", "location_id", "temperature_c")


@query("WITH " + OBS + " SELECT event_id FROM obs WHERE temperature_c BETWEEN -90 AND 60 AND humidity_pct BETWEEN 0 AND 100 AND precipitation_mm >= 0")
def history_valid(spark, d):
    """FLT-03."""
    return observations(spark, d).filter(quality.valid_history()).select("event_id")


@query(f"WITH {RAW} SELECT event_id, \"offset\", copy FROM raw QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY \"partition\", \"offset\") = 1")
def dedupe_first(spark, d):
    """WIN-08, STR-02 on a batch."""
    return dedupe.within_watermark(raw(spark, d), "event_id", "event_time", "10 minutes", F.col("partition"), F.col("offset")).select("event_id", "offset", "copy")


@query("WITH " + OBS + ", v AS (SELECT user_id, date_trunc('day', event_time) AS day, count(*) AS n, count(DISTINCT humidity_pct) AS versions FROM obs GROUP BY ALL) SELECT CAST(coalesce(sum(n - 1) FILTER (versions <= 1), 0) AS BIGINT) AS duplicate_rows, count(*) FILTER (versions > 1) AS conflict_keys, CAST(coalesce(sum(n) FILTER (versions > 1), 0) AS BIGINT) AS conflict_rows FROM v")
def conflict_totals(spark, d):
    """AGG-04/05/06."""
    return dedupe.conflict_totals(observations(spark, d).withColumn("day", F.date_trunc("day", "event_time")), ["user_id", "day"], "humidity_pct")


@query("WITH " + OBS + " SELECT user_id, " + sec("date_trunc('day', event_time)") + " AS day_second, count(*) AS n, count(DISTINCT humidity_pct) AS versions FROM obs GROUP BY ALL HAVING count(DISTINCT humidity_pct) > 1")
def conflict_keys(spark, d):
    """AGG-05."""
    v = dedupe.versions(observations(spark, d).withColumn("day", F.date_trunc("day", "event_time")), ["user_id", "day"], "humidity_pct")
    return v.filter("versions > 1").select("user_id", seconds("day").alias("day_second"), "n", "versions")


@query(f"WITH {RAW} SELECT event_id, count(*) AS n FROM raw GROUP BY event_id HAVING count(*) > 1")
def duplicate_groups(spark, d):
    """AGG-07."""
    return dedupe.repeated(raw(spark, d), ["event_id"])


@query(f"WITH {RAW} SELECT CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS excess_rows FROM raw")
def excess_duplicates(spark, d):
    """AGG-08."""
    return dedupe.excess(raw(spark, d), ["event_id"])


@query(f"WITH {RAW}, r AS (SELECT event_id, \"offset\", CASE WHEN location_id IS NULL OR location_id = 'view' THEN 'UNKNOWN_LOCATION' WHEN event_time IS NULL THEN 'INVALID_EVENT_TIME' WHEN CAST(floor(epoch(event_time)) AS BIGINT) % 3600 <> 0 AND event_id % 5 = 0 THEN 'NON_HOURLY' WHEN abs(latitude) > 90 OR abs(longitude) > 180 THEN 'INVALID_COORDINATE' WHEN temperature_c = 999 THEN 'INVALID_WEATHER_VALUE' END AS reason FROM raw) SELECT coalesce(reason, 'NONE') AS reason, count(*) AS n FROM r GROUP BY ALL")
def reject_reasons(spark, d):
    """FLT-06/07: ordered reasons; here three quarters of the rows are moved to whole hours and 999 becomes NaN."""
    r = raw(spark, d).withColumn("event_time", F.when(F.col("event_id") % 5 == 0, F.col("event_time")).otherwise(F.date_trunc("hour", "event_time"))).withColumn("temperature_c", F.when(F.col("temperature_c") != 999, F.col("temperature_c")).otherwise(float("nan")))
    known = F.coalesce(F.col("location_id") != "view", F.lit(False))
    return r.groupBy(F.coalesce(quality.reject_reason(known, values=("temperature_c",)), F.lit("NONE")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {RAW} SELECT event_id, \"offset\", coalesce(array_to_string(list_sort(list_filter([CASE WHEN location_id IS NULL THEN 'UNKNOWN_LOCATION' END, CASE WHEN temperature_c > 60 THEN 'INVALID_PREDICTION' END, CASE WHEN event_id % 7 = 0 THEN 'MISSING_SOURCE' END], lambda x: x IS NOT NULL)), ';'), '') AS errors FROM raw")
def multi_error_list(spark, d):
    """FLT-10."""
    checks = {"UNKNOWN_LOCATION": F.col("location_id").isNull(), "INVALID_PREDICTION": F.col("temperature_c") > 60, "MISSING_SOURCE": F.col("event_id") % 7 == 0}
    return raw(spark, d).select("event_id", "offset", quality.all_errors(checks).alias("errors"))


@query(f"WITH {RAW} SELECT event_id FROM raw WHERE location_id IS DISTINCT FROM 'click' AND copy = 0")
def provenance_mismatch(spark, d):
    """FLT-09: null-safe difference from what is expected."""
    return raw(spark, d).filter(quality.mismatch({"location_id": F.lit("click")}) & (F.col("copy") == 0)).select("event_id")


def _gold(n: str, extra: str = "") -> str:
    stats = f"count(*) AS n, {s6('avg(temperature_c)')} AS mean, min(temperature_c) AS least, max(temperature_c) AS most, {s6('stddev_pop(temperature_c)')} AS std, {s6('sum(precipitation_mm)')} AS total"
    return f"{extra}{stats}"


@query(f"WITH {RAW}, v AS (SELECT * FROM raw WHERE {VALID} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY \"offset\") = 1), w AS (SELECT *, CAST(floor(epoch(event_time) / 300) AS BIGINT) * 300 - 300 * i AS window_start FROM v, range(6) r(i)) SELECT window_start, window_start + 1800 AS window_end, location_id, {_gold('w')} FROM w GROUP BY window_start, location_id")
def gold_sliding(spark, d):
    """STR-03, AGG-01 over FLT-01 and WIN-08: 30-minute windows every 5 minutes."""
    valid = quality.split_valid(raw(spark, d), quality.valid_observation())[0]
    unique = dedupe.first_by(valid, ["event_id"], F.col("offset"))
    g = windows.windowed(unique, "event_time", "30 minutes", "5 minutes", ["location_id"], windows.measures("temperature_c", "precipitation_mm"))
    return g.select(seconds("window_start").alias("window_start"), seconds("window_end").alias("window_end"), "location_id", "n", six(F.col("mean")).alias("mean"), "least", "most", six(F.col("std")).alias("std"), six(F.col("total")).alias("total"))


FAULT = "CASE WHEN event_id % 97 = 0 THEN 'DUPLICATE' WHEN event_id % 89 = 0 THEN 'INVALID' WHEN event_id % 20 = 7 THEN 'LATE' END"


@query(f"WITH {OBS} SELECT {sec("date_trunc('hour', event_time)")} AS window_start, location_id, coalesce({FAULT}, 'NULL') AS fault, count(*) AS n, {s6('avg(temperature_c)')} AS mean, {sec('min(event_time)')} AS first_second, {sec('max(event_time)')} AS last_second FROM obs GROUP BY ALL")
def gold_tumbling_faults(spark, d):
    """STR-04, AGG-31: one-hour windows by location and fault, a null fault in a bucket of its own."""
    fault = F.when(F.col("event_id") % 97 == 0, "DUPLICATE").when(F.col("event_id") % 89 == 0, "INVALID").when(F.col("event_id") % 20 == 7, "LATE")
    o = observations(spark, d).withColumn("fault", F.coalesce(fault, F.lit("NULL")))
    g = windows.windowed(o, "event_time", "1 hour", None, ["location_id", "fault"], windows.measures("temperature_c", time="event_time"))
    return g.select(seconds("window_start").alias("window_start"), "location_id", "fault", "n", six(F.col("mean")).alias("mean"), seconds("first_time").alias("first_second"), seconds("last_time").alias("last_second"))


@query("WITH " + OBS + " SELECT count(DISTINCT (location_id, user_id)) AS pairs, count(DISTINCT location_id) AS locations, count(*) AS n FROM obs")
def distinct_struct_counts(spark, d):
    """AGG-04."""
    return observations(spark, d).agg(F.countDistinct(F.struct("location_id", "user_id")).alias("pairs"), F.countDistinct("location_id").alias("locations"), F.count("*").alias("n"))


@query("WITH " + OBS + ", x AS (SELECT location_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 'nan'::DOUBLE WHEN event_id % 10 = 2 THEN 'inf'::DOUBLE ELSE temperature_c END AS t, humidity_pct AS h FROM obs) SELECT location_id, 't' AS \"column\", count(*) FILTER (t IS NULL) AS nulls, count(*) FILTER (isnan(t)) AS nans, count(*) FILTER (isinf(t)) AS infinities FROM x GROUP BY ALL UNION ALL SELECT location_id, 'h', count(*) FILTER (h IS NULL), count(*) FILTER (isnan(h)), count(*) FILTER (isinf(h)) FROM x GROUP BY ALL")
def null_nan_inf_profile(spark, d):
    """AGG-15."""
    m = F.col("event_id") % 10
    t = F.when(m == 0, None).when(m == 1, float("nan")).when(m == 2, float("inf")).otherwise(F.col("temperature_c"))
    return quality.profile(observations(spark, d).withColumn("t", t).withColumn("h", F.col("humidity_pct")), ["t", "h"], ["location_id"])


@query("WITH " + OBS + " SELECT event_id FROM obs WHERE event_id % 3 = 0")
def finite_values(spark, d):
    """FLT-04: NaN, infinities and nulls are not finite."""
    m = F.col("event_id") % 3
    return observations(spark, d).withColumn("t", F.when(m == 0, F.col("temperature_c")).when(m == 1, float("nan")).otherwise(float("-inf"))).filter(finite(F.col("t"))).select("event_id")


@query(f"WITH {OBS} SELECT location_id, c AS \"column\", count(v) AS n, min(v) AS least, max(v) AS most, {s6('avg(v)')} AS mean, {s6('stddev_pop(v)')} AS std FROM (SELECT location_id, 'temperature_c' AS c, temperature_c AS v FROM obs UNION ALL SELECT location_id, 'humidity_pct', humidity_pct FROM obs) GROUP BY ALL")
def value_stats(spark, d):
    """AGG-16."""
    v = quality.value_stats(observations(spark, d), ["temperature_c", "humidity_pct"], ["location_id"])
    return v.select("location_id", "column", "n", "least", "most", six(F.col("mean")).alias("mean"), six(F.col("std")).alias("std"))


@query("SELECT event_type AS category, count(*) AS n, " + s6("count(*) / sum(count(*)) OVER ()") + " AS fraction FROM events GROUP BY event_type")
def category_fractions(spark, d):
    """AGG-14."""
    return quality.category_shares(load(spark, d, "events"), "event_type").select("category", "n", six(F.col("fraction")).alias("fraction"))


@query("WITH " + OBS + " SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (temperature_c > 50) AS BIGINT) AS hot, CAST(count(*) FILTER (humidity_pct > 50) AS BIGINT) AS wet FROM obs")
def global_conditional_counts(spark, d):
    """AGG-02/03."""
    return observations(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("temperature_c") > 50).alias("hot"), F.count_if(F.col("humidity_pct") > 50).alias("wet"))


@query(f"WITH {RAW} SELECT event_id, sha256('LIVE|' || coalesce(location_id, '') || '|' || strftime(event_time, '%Y-%m-%dT%H:%M:%SZ')) AS sourced_id, sha256(concat_ws(chr(0), 'E', CAST(event_id AS VARCHAR), coalesce(location_id, ''))) AS stable FROM raw WHERE copy = 0")
def deterministic_ids(spark, d):
    """§1.4: null parts count as empty text."""
    r = raw(spark, d).filter("copy = 0")
    return r.select("event_id", F.sha2(ids.sourced_event_id(F.lit("LIVE"), F.col("location_id"), F.col("event_time")), 256).alias("sourced_id"), ids.stable_id(F.lit("E"), F.col("event_id"), F.col("location_id")).alias("stable"))


@query(f"WITH {RAW}, c AS (SELECT user_id, event_id, \"offset\", row_number() OVER w AS r, humidity_pct, first_value(humidity_pct) OVER w AS f FROM raw WINDOW w AS (PARTITION BY user_id ORDER BY \"offset\")) SELECT user_id, CASE WHEN r = 1 THEN 'CANONICAL' WHEN humidity_pct = f THEN 'DUPLICATE' ELSE 'REVISION' END AS outcome, count(*) AS n FROM c GROUP BY ALL")
def archive_first_wins(spark, d):
    """CMP-09."""
    return dedupe.canonical(raw(spark, d), ["user_id"], "humidity_pct", F.col("offset")).groupBy("user_id", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {RAW}, v AS (SELECT *, {VALID} IS TRUE AS ok FROM raw), s AS (SELECT count(*) AS bronze, count(DISTINCT event_id) FILTER (ok) AS silver, count(*) FILTER (NOT ok) AS dead, count(*) FILTER (ok) AS valid FROM v) SELECT 'adds_up' AS assertion, CASE WHEN bronze = valid + dead THEN 'PASS' ELSE 'FAIL' END AS result FROM s UNION ALL SELECT 'has_duplicates', CASE WHEN bronze - silver - dead > 0 THEN 'PASS' ELSE 'FAIL' END FROM s UNION ALL SELECT 'unknown', 'FAIL'")
def conservation_report(spark, d):
    """CMP-15."""
    r = raw(spark, d)
    valid, dead = quality.split_valid(r, quality.valid_observation())
    one = audit.conservation(r, dedupe.first_by(valid, ["event_id"], F.col("offset")), dead)
    return audit.report(one, {"adds_up": F.col("bronze") == F.col("silver") + F.col("dead") + F.col("removed"), "has_duplicates": F.col("removed") > 0, "unknown": F.lit(None).cast("boolean")})


@query(f"WITH {RAW} SELECT location_id, count(*) AS n, count(*) FILTER (event_time < before) AS out_of_order FROM (SELECT location_id, event_time, lag(event_time) OVER (PARTITION BY location_id ORDER BY (event_id * 7919) % 10007, event_id, copy) AS before FROM raw WHERE location_id IS NOT NULL) GROUP BY ALL")
def out_of_order_count(spark, d):
    """WIN-18."""
    arrival = F.struct((F.col("event_id") * 7919) % 10007, "event_id", "copy")
    return audit.out_of_order(raw(spark, d).filter("location_id is not null").withColumn("arrival", arrival), "location_id", "arrival", "event_time")


@query()
def replay_faults(spark, d):
    """STR-15: seeded faults; counted by fault, with how far rows are carried behind."""
    r = faults.corrupt(faults.replay(observations(spark, d), "event_id"), "event_id")
    return r.groupBy("fault").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(quality.valid_observation(), F.lit(False))).alias("invalid"), F.max(F.col("arrival") - F.col("event_id")).alias("largest_delay"))
