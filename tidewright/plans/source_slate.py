"""Queries: file sources and reports read back, gates of raw sets, rolling values on the whole grid (§2.1, 2.2, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import utc_text
from ..functions.numbers import finite, six
from ..operators import features, gates, metrics
from ..sources import readers
from ..sources.merge import append_metrics, staged_write
from .base import OBS, PANEL, load, observations, panel, query, s6, scratch, sec, seconds
from .panel_slate import GRID

EVENT = "event_id long, event_type string, value double"


def _events(spark, d):
    return load(spark, d, "events").select("event_id", "event_type", "value")


@query("SELECT event_id, event_type, value FROM events")
def json_lines_gzip(spark, d):
    """SRC-09: written as gzip JSON lines and read by a glob."""
    folder = scratch(spark)
    _events(spark, d).write.option("compression", "gzip").json(f"{folder}/lines")
    return readers.json_lines(spark, f"{folder}/lines/*.json.gz", EVENT).select("event_id", "event_type", "value")


@query("""SELECT event_type, line, text FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line,
  '{broken ' || event_id AS text FROM events WHERE event_type IS NOT NULL) WHERE event_id % 97 = 0 AND event_id % 89 <> 0""")
def json_line_errors(spark, d):
    """SRC-14: a file for each event type with blank and broken lines."""
    folder = scratch(spark)
    i = F.col("event_id")
    line = F.when(i % 89 == 0, "").when(i % 97 == 0, F.concat(F.lit("{broken "), i)).otherwise(F.to_json(F.struct("event_id", "value")))
    lines = _events(spark, d).filter("event_type is not null").repartition("event_type").sortWithinPartitions("event_type", "event_id")
    lines.select("event_type", line.alias("value")).write.partitionBy("event_type").text(f"{folder}/lines")
    bad = readers.json_errors(spark, f"{folder}/lines", "event_id long, value double")
    return bad.select(F.regexp_extract("file", "event_type=([^/]*)", 1).alias("event_type"), "line", "text")


@query("SELECT event_id, value FROM events WHERE value > 10")
def parquet_tree_filter(spark, d):
    """SRC-10: files at several depths, filtered at the scan."""
    folder = scratch(spark)
    _events(spark, d).filter("event_id % 2 = 0").write.parquet(f"{folder}/tree/even")
    _events(spark, d).filter("event_id % 2 = 1").write.parquet(f"{folder}/tree/odd/deeper")
    return readers.parquet_tree(spark, f"{folder}/tree", F.col("value") > 10).select("event_id", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def partitioned_pruned(spark, d):
    """SRC-11/13, SNK-08: one partition and two columns of a partitioned set."""
    folder = scratch(spark)
    _events(spark, d).write.partitionBy("event_type").parquet(f"{folder}/set")
    return readers.partitioned(spark, f"{folder}/set", ["event_id", "event_type"], event_type="click")


@query("SELECT n_name AS location_id, 10.0::DOUBLE + n_nationkey AS latitude, 100.0::DOUBLE + n_nationkey AS longitude FROM nation WHERE n_regionkey = 1")
def location_catalog(spark, d):
    """SRC-15: a JSON list of places, those of one dataset."""
    folder = scratch(spark)
    n = F.col("n_nationkey").cast("double")
    place = F.struct(F.col("n_name").alias("location_id"), (n + 10).alias("latitude"), (n + 100).alias("longitude"), F.array(F.concat(F.lit("set"), "n_regionkey")).alias("dataset_memberships"))
    listed = load(spark, d, "nation").agg(F.to_json(F.collect_list(place)).alias("value"))  # a catalog is one small file
    listed.write.text(f"{folder}/catalog")
    return readers.catalog(spark, f"{folder}/catalog", "set1").select("location_id", "latitude", "longitude")


@query("SELECT kind, event_type, count(*) AS n FROM events, (VALUES ('csv'), ('json')) k(kind) GROUP BY ALL")
def report_read_back(spark, d):
    """SNK-11: a report as JSON and as CSV, written beside and moved into place."""
    folder = scratch(spark)
    summary = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    for kind in ("csv", "json"):
        staged_write(summary, f"{folder}/{kind}", kind=kind)
    read = {"csv": spark.read.option("header", "true").csv(f"{folder}/csv"), "json": spark.read.json(f"{folder}/json")}
    csv, json = (df.select(F.lit(kind).alias("kind"), "event_type", F.col("n").cast("long").alias("n")) for kind, df in read.items())
    return csv.unionByName(json)


@query("SELECT event_id % 3 AS batch_id, count(*) AS rows, max(event_id) AS last_id FROM events GROUP BY ALL")
def batch_metrics_log(spark, d):
    """SNK-12: a line for each of three batches, appended."""
    folder = scratch(spark)
    for batch in range(3):
        rows = _events(spark, d).filter(F.col("event_id") % 3 == batch)
        append_metrics(rows.groupBy(F.lit(batch).alias("batch_id")).agg(F.count("*").alias("rows"), F.max("event_id").alias("last_id")), f"{folder}/metrics")
    return readers.json_lines(spark, f"{folder}/metrics", "batch_id long, rows long, last_id long").select("batch_id", "rows", "last_id")


#: Raw text rows with faults of each gate planted by id.
RAW_TEXT = """raw_text AS (SELECT CASE WHEN i % 107 = 0 THEN NULL WHEN i % 109 = 0 THEN 'other' ELSE location_id || '_' || event_time END AS event_id, * EXCLUDE (i, event_id), i FROM
  (SELECT event_id AS i, event_id, CASE WHEN event_id % 103 = 0 THEN 'nowhere' ELSE event_type END AS location_id, CASE WHEN event_id % 101 = 0 THEN 'yesterday' WHEN event_id % 113 = 0
  THEN strftime(ts, '%Y-%m-%dT%H:30:00Z') ELSE strftime(ts, '%Y-%m-%dT%H:00:00Z') END AS event_time, CASE WHEN event_id % 127 = 0 THEN NULL ELSE value END AS temperature_c, date_trunc('hour', ts) AS hour FROM events)),
judged AS (SELECT *, location_id <> 'nowhere' AS known, i % 101 = 0 AS malformed, i % 101 <> 0 AND i % 113 = 0 AS off_hour FROM raw_text)"""


def raw_text(spark, d):
    i = F.col("i")
    e = load(spark, d, "events").withColumn("i", F.col("event_id"))
    place = F.when(i % 103 == 0, "nowhere").otherwise(F.col("event_type"))
    hour = F.date_trunc("hour", "ts")
    time = F.when(i % 101 == 0, "yesterday").when(i % 113 == 0, utc_text(hour + F.expr("INTERVAL 30 MINUTE"))).otherwise(utc_text(hour))
    named = e.select("i", place.alias("location_id"), time.alias("event_time"), F.when(i % 127 != 0, F.col("value")).alias("temperature_c"))
    own = F.when(i % 107 == 0, None).when(i % 109 == 0, "other").otherwise(F.concat_ws("_", "location_id", "event_time"))
    return named.withColumn("event_id", own).drop("i")


def _places(spark, d):
    return load(spark, d, "events").select(F.col("event_type").alias("location_id")).distinct()


@query(f"""WITH {RAW_TEXT}, g AS (SELECT 'event_id_missing' AS gate, count(*) FILTER (event_id IS NULL) AS n FROM judged UNION ALL SELECT 'location_id_missing', count(*) FILTER (location_id IS NULL) FROM judged
  UNION ALL SELECT 'event_time_missing', count(*) FILTER (event_time IS NULL) FROM judged UNION ALL SELECT 'event_id_differs', count(*) FILTER (i % 107 = 0 OR i % 109 = 0) FROM judged
  UNION ALL SELECT 'location_unknown', count(*) FILTER (NOT known) FROM judged UNION ALL SELECT 'time_malformed', count(*) FILTER (malformed) FROM judged UNION ALL SELECT 'time_off_hour', count(*) FILTER (off_hour) FROM judged
  UNION ALL SELECT 'measures_invalid', count(*) FILTER (temperature_c IS NULL) FROM judged UNION ALL SELECT 'event_id_repeated', count(event_id) - count(DISTINCT event_id) FROM judged
  UNION ALL SELECT 'observation_repeated', count(*) - count(DISTINCT (location_id, hour)) FROM judged WHERE known AND NOT malformed AND NOT off_hour)
SELECT gate, n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM g""")
def raw_dataset_gates(spark, d):
    """CMP-17: ten gates over text rows with planted faults."""
    return gates.raw_gates(raw_text(spark, d), _places(spark, d), finite(F.col("temperature_c")))


@query(f"""WITH {RAW_TEXT}, f AS (SELECT location_id, year(hour) AS year, count(*) AS rows, count(DISTINCT hour) AS hours FROM judged WHERE known AND NOT malformed AND NOT off_hour GROUP BY ALL),
  e AS (SELECT DISTINCT event_type AS location_id, y AS year, h AS expected FROM events, (VALUES (2023, 8760), (2024, 8784)) t(y, h))
SELECT location_id, CAST(e.year AS INTEGER) AS year, coalesce(rows, 0) AS rows, coalesce(hours, 0) AS hours, expected - coalesce(hours, 0) AS missing_hours, expected > coalesce(hours, 0) AS affected
FROM e LEFT JOIN f USING (location_id, year)""")
def raw_completeness(spark, d):
    """CMP-17, by place and year."""
    return gates.completeness(raw_text(spark, d), _places(spark, d), [2023, 2024])


_ROLLED = {"mean": "avg", "std": "stddev_pop", "sum": "sum"}


@query(f"WITH {PANEL}, {GRID} SELECT location_id, {sec('event_time')} AS second, " + ", ".join(f"CASE WHEN count(temperature_c) OVER w >= 3 THEN {s6(f'{f}(temperature_c) OVER w')} END AS temperature_c_{n}_6" for n, f in _ROLLED.items()) + " FROM g LEFT JOIN panel USING (location_id, event_time) WINDOW w AS (PARTITION BY location_id ORDER BY event_time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def rolling_min_periods(spark, d):
    """WIN-12."""
    r = features.rolled_on_grid(panel(spark, d), "location_id", "event_time", "temperature_c", 6, 3)
    return r.select("location_id", seconds("event_time").alias("second"), *(six(F.col(c)).alias(c) for c in r.columns[2:]))


@query(f"WITH {OBS}, t AS (SELECT * FROM obs WHERE event_time < '2024-01-15'), l AS (SELECT 'temperature_c' AS \"column\", temperature_c AS v FROM t UNION ALL SELECT 'humidity_pct', humidity_pct FROM t) SELECT \"column\", count(v) AS count, {s6('quantile_cont(v, 0.01)')} AS p01, {s6('quantile_cont(v, 0.99)')} AS p99 FROM l GROUP BY ALL")
def train_percentiles(spark, d):
    """AGG-13: p01 and p99 of TRAIN rows only."""
    split = features.split_name(F.col("event_time"), (("TRAIN", None, "2024-01-15"), ("TEST", "2024-01-15", None)))
    bounds = metrics.train_bounds(observations(spark, d).withColumn("split", split), ["temperature_c", "humidity_pct"])
    return bounds.select("column", "count", six(F.col("p01")).alias("p01"), six(F.col("p99")).alias("p99"))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def already_written_ids(spark, d):
    """JON-18."""
    new, there = load(spark, d, "orders").select(F.col("o_custkey").alias("id")), load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return gates.already_written(new, there, "id")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view'")
def run_scope(spark, d):
    """FLT-12: the event type stands for the run."""
    return gates.in_run(load(spark, d, "events"), "view", "event_type").select("event_id", "user_id")
