"""Queries: analysis of streaming runs (§2.5, 2.7, 2.12). Runs, batches and configurations are derived from the test tables."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..functions.ids import log_partition
from ..functions.numbers import six
from ..operators import audit, perf
from .base import load, query, s6, seconds

#: A run per supplier: rates, lags and drains that reach every class.
RUNS = """runs AS (SELECT s_suppkey AS run, 'p' || (s_suppkey % 3 + 1) || '-b' || (s_suppkey % 2 + 1) || '-s' || (s_suppkey % 2 + 1) || '-w1' AS config, s_suppkey % 17 = 0 AS failed, s_suppkey % 13 <> 0 AS completed,
  CASE WHEN s_suppkey % 19 <> 0 THEN CASE WHEN s_suppkey % 11 = 0 THEN 5 ELSE 0 END END AS final_lag, 1000.0::DOUBLE AS offered, 1000.0::DOUBLE * (0.8 + (s_suppkey % 7) * 0.04) AS sustained,
  (s_suppkey % 23) * 8.0::DOUBLE AS slope, CASE WHEN s_suppkey % 29 <> 0 THEN (s_suppkey % 31) * 1.0::DOUBLE END AS drain, 40.0::DOUBLE AS duration FROM supplier)"""
CLASS = """CASE WHEN failed OR final_lag IS NULL THEN 'FAILED' WHEN NOT completed OR final_lag > 0 THEN 'SATURATED' WHEN slope > greatest(20, offered * 0.1) AND sustained / offered < 0.9 THEN 'SATURATED'
  WHEN slope <= greatest(10, offered * 0.02) AND sustained / offered >= 0.95 AND drain <= greatest(15, duration * 0.25) THEN 'UNDER_CAPACITY' ELSE 'NEAR_CAPACITY' END"""


def runs(spark, d):
    k = F.col("s_suppkey")
    s = load(spark, d, "supplier")
    config = F.concat(F.lit("p"), k % 3 + 1, F.lit("-b"), k % 2 + 1, F.lit("-s"), k % 2 + 1, F.lit("-w1"))
    return s.select(
        k.alias("run"), config.alias("config"), (k % 17 == 0).alias("failed"), (k % 13 != 0).alias("completed"), F.when(k % 19 != 0, F.when(k % 11 == 0, 5).otherwise(0)).alias("final_lag"), F.lit(1000.0).alias("offered"),
        (1000.0 * (0.8 + (k % 7) * 0.04)).alias("sustained"), ((k % 23) * 8.0).alias("slope"), F.when(k % 29 != 0, (k % 31) * 1.0).alias("drain"), F.lit(40.0).alias("duration"),
    )


def classed(spark, d):
    c = [F.col(x) for x in ("failed", "completed", "final_lag", "offered", "sustained", "slope", "drain", "duration")]
    return runs(spark, d).withColumn("capacity", perf.capacity(*c))


@query(f"WITH {RUNS} SELECT run, {CLASS} AS capacity FROM runs")
def capacity_class(spark, d):
    """CMP-21."""
    return classed(spark, d).select("run", "capacity")


@query(f"WITH {RUNS}, c AS (SELECT *, {CLASS} AS capacity FROM runs) SELECT config, count(*) AS runs, {s6('avg(sustained)')} AS mean, {s6('quantile_cont(sustained, 0.5)')} AS median, {s6('min(sustained)')} AS least, {s6('max(sustained)')} AS most, CASE min(CASE capacity WHEN 'FAILED' THEN 1 WHEN 'SATURATED' THEN 2 WHEN 'NEAR_CAPACITY' THEN 3 ELSE 4 END) WHEN 1 THEN 'FAILED' WHEN 2 THEN 'SATURATED' WHEN 3 THEN 'NEAR_CAPACITY' ELSE 'UNDER_CAPACITY' END AS worst FROM c GROUP BY ALL")
def repetition_summary(spark, d):
    """CMP-22, AGG-26."""
    r = perf.repetitions(classed(spark, d), ["config"], "sustained")
    return r.select("config", "runs", *(six(F.col(c)).alias(c) for c in ("mean", "median", "least", "most")), "worst")


@query(f"WITH {RUNS} SELECT run, {s6('sustained / 800.0')} AS speedup, {s6('(sustained / 800.0 - 1) * 100')} AS gain_pct, {s6('CASE WHEN run % 5 > 0 THEN sustained / 800.0 / (run % 5 / 2.0) END')} AS efficiency, {s6('CASE WHEN run % 5 > 0 THEN sustained / (run % 5) END')} AS rows_per_core FROM runs")
def scaling_efficiency(spark, d):
    """CMP-23: no cores give no efficiency."""
    m = perf.scaling(F.lit(800.0), F.col("sustained"), F.lit(2.0), F.col("run") % 5)
    return runs(spark, d).select("run", *(six(m[c]).alias(c) for c in ("speedup", "gain_pct", "efficiency", "rows_per_core")))


@query(f"WITH {RUNS}, c AS (SELECT *, {CLASS} AS capacity FROM runs), n AS (SELECT * FROM c WHERE capacity <> 'SATURATED'), t AS (SELECT * FROM n WHERE ((SELECT max(sustained) FROM n) - sustained) / (SELECT max(sustained) FROM n) <= 0.02) SELECT run, config FROM t ORDER BY drain NULLS LAST, slope, run LIMIT 1")
def best_config(spark, d):
    """SRT-08, CMP-30: within 2 % of the best, ties by order, absent values last."""
    return perf.best_config(classed(spark, d), "sustained", ["drain", "slope", "run"]).select("run", "config")


@query(f"WITH {RUNS} SELECT run, coalesce(array_to_string(list_filter([CASE WHEN failed THEN 'run failed' END, CASE WHEN NOT completed THEN 'not completed' END, CASE WHEN final_lag IS DISTINCT FROM 0 THEN 'final lag' END], lambda x: x IS NOT NULL), ';'), '') AS reasons, CASE WHEN NOT failed AND completed AND final_lag = 0 THEN least(sustained, 900.0) END AS pipeline_rate FROM runs")
def eligibility_audit(spark, d):
    """CMP-24."""
    why = perf.exclusion_reasons({"run failed": ~F.col("failed"), "not completed": F.col("completed"), "final lag": F.col("final_lag") == 0})
    return runs(spark, d).select("run", F.array_join(why, ";").alias("reasons"), perf.pipeline_rate(F.col("sustained"), F.lit(900.0), why).alias("pipeline_rate"))


@query(f"WITH {RUNS} SELECT run, CAST(regexp_extract(config, 'p(\\d+)', 1) AS INTEGER) AS partitions, CAST(regexp_extract(config, 'b(\\d+)', 1) AS INTEGER) AS bronze_cores, CAST(regexp_extract(config, 's(\\d+)', 1) AS INTEGER) AS silver_cores, CAST(regexp_extract(config, 'w(\\d+)', 1) AS INTEGER) AS workers FROM runs")
def config_identifiers(spark, d):
    """§2.9 regular expressions."""
    return runs(spark, d).select("run", *(v.alias(k) for k, v in perf.config_parts(F.col("config")).items()))


@query("SELECT min(n) AS least, max(n) AS most, " + s6("avg(n)") + " AS mean, " + s6("max(n) / avg(n)") + " AS imbalance FROM (SELECT p, CAST(count(event_id) AS BIGINT) AS n FROM range(40) r(p) LEFT JOIN events ON user_id % 37 = p GROUP BY p)")
def partition_skew(spark, d):
    """AGG-27: empty partitions count."""
    s = perf.skew(load(spark, d, "events"), F.col("user_id") % 37, 40)
    return s.select("least", "most", six(F.col("mean")).alias("mean"), six(F.col("imbalance")).alias("imbalance"))


# The event types of the test tables; SQL has no CRC-32, so theirs are listed.
EVENT_TYPES = ('click', 'error', 'purchase', 'signup', 'view')
_CRC = ", ".join(f"('{x}', {zlib.crc32(x.encode())})" for x in EVENT_TYPES)


@query(f"WITH c(event_type, crc) AS (VALUES {_CRC}) SELECT crc % 6 AS p, count(*) AS n, count(DISTINCT event_type) AS keys FROM events LEFT JOIN c USING (event_type) GROUP BY ALL")
def crc32_partitions(spark, d):
    """§2.9 hash: rows by CRC-32 of the key."""
    e = load(spark, d, "events").withColumn("p", log_partition(F.col("event_type"), 6))
    return e.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("keys"))


PROGRESS = """progress AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'bronze' ELSE 'silver' END AS stage, 'q' || (event_id % 2) AS "query", CAST(event_id // 100 AS BIGINT) AS batch_id, ts AS captured, value AS processed_rate, CAST(event_id % 50 AS BIGINT) AS rows, CAST(event_id % 1000 AS BIGINT) AS duration_ms FROM events)"""


def progress(spark, d):
    i = F.col("event_id")
    return load(spark, d, "events").select(F.when(i % 2 == 0, "bronze").otherwise("silver").alias("stage"), F.concat(F.lit("q"), i % 2).alias("query"), F.floor(i / 100).alias("batch_id"), F.col("ts").alias("captured"), F.col("value").alias("processed_rate"), (i % 50).alias("rows"), (i % 1000).alias("duration_ms"))


@query(f"WITH {PROGRESS} SELECT stage, count(DISTINCT (\"query\", batch_id)) AS batches, CAST(sum(rows) AS BIGINT) AS rows, {s6('avg(processed_rate)')} AS avg_rate, {s6('quantile_cont(processed_rate, 0.5)')} AS median_rate, max(duration_ms) AS longest_ms FROM progress GROUP BY ALL")
def progress_summary(spark, d):
    """CMP-19."""
    return perf.stage_summary(progress(spark, d)).select("stage", "batches", "rows", six(F.col("avg_rate")).alias("avg_rate"), six(F.col("median_rate")).alias("median_rate"), "longest_ms")


@query(f"WITH {PROGRESS}, b AS (SELECT stage, \"query\", batch_id, max(captured) AS c FROM progress GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stage, \"query\" ORDER BY batch_id) AS i FROM b), cut AS (SELECT max(c) AS c FROM r WHERE i = 3), w AS (SELECT greatest(c, TIMESTAMP '2024-01-01 00:00:10') AS s FROM cut) SELECT CAST(floor(epoch(s)) AS BIGINT) AS steady_second, count(*) FILTER (captured >= s AND captured <= TIMESTAMP '2024-01-20') AS samples FROM w, progress GROUP BY ALL")
def steady_window(spark, d):
    """CMP-18, WIN-20."""
    s = perf.steady_window(progress(spark, d), F.to_timestamp(F.lit("2024-01-01")), F.to_timestamp(F.lit("2024-01-20")))
    return s.select(seconds("steady_start").alias("steady_second"), "samples")


@query(f"WITH x AS (SELECT ts AS captured, CAST(event_id % 977 AS DOUBLE) AS lag FROM events), i AS (SELECT *, captured BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20' AS inside, captured >= TIMESTAMP '2024-01-05' AS calm FROM x), k AS (SELECT * FROM i WHERE inside AND calm) SELECT (SELECT max(lag) FROM i WHERE inside AND NOT calm) AS startup_peak, (SELECT max(lag) FROM k) AS steady_peak, (SELECT {s6('avg(lag)')} FROM k) AS steady_mean, (SELECT {s6('quantile_cont(lag, 0.95)')} FROM k) AS steady_p95, (SELECT CAST(count(*) AS BIGINT) FROM x) AS samples")
def lag_summary(spark, d):
    """CMP-20."""
    x = load(spark, d, "events").select(F.col("ts").alias("captured"), (F.col("event_id") % 977).cast("double").alias("lag"))
    t = lambda s: F.to_timestamp(F.lit(s))
    s = perf.lag_summary(x, t("2024-01-02"), t("2024-01-05"), t("2024-01-20"))
    return s.select("startup_peak", "steady_peak", six(F.col("steady_mean")).alias("steady_mean"), six(F.col("steady_p95")).alias("steady_p95"), "samples")


@query(f"WITH {PROGRESS} SELECT stage, arg_max(duration_ms, (batch_id, captured, duration_ms)) AS duration_ms FROM progress GROUP BY ALL")
def latest_by_batch(spark, d):
    """AGG-28."""
    return perf.latest_by(progress(spark, d), ["stage"], "duration_ms", "batch_id", "captured", "duration_ms")


@query(f"WITH {PROGRESS}, c AS (SELECT stage, batch_id, CAST(sum(rows) AS BIGINT) AS rows FROM progress GROUP BY ALL), s AS (SELECT *, sum(rows) OVER (PARTITION BY stage ORDER BY batch_id) AS total FROM c) SELECT stage, min(batch_id) FILTER (total >= 2000) AS completed FROM s GROUP BY ALL")
def completion_batch(spark, d):
    """WIN-19."""
    c = progress(spark, d).groupBy("stage", "batch_id").agg(F.sum("rows").alias("rows"))
    return perf.completion(c, ["stage"], "batch_id", "rows", F.lit(2000))


@query(f"WITH w AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, user_id % 4 AS worker, avg(value) AS v FROM events GROUP BY ALL), t AS (SELECT h, sum(v) AS total FROM w GROUP BY ALL) SELECT {s6('avg(total)')} AS mean, {s6('max(total)')} AS peak, count(*) AS samples FROM t")
def resource_totals(spark, d):
    """AGG-29: workers add up at each time, then statistics over time."""
    w = load(spark, d, "events").groupBy(F.floor(F.unix_seconds("ts") / 3600).alias("h"), (F.col("user_id") % 4).alias("worker")).agg(F.avg("value").alias("v"))
    return w.groupBy("h").agg(F.sum("v").alias("total")).agg(six(F.avg("total")).alias("mean"), six(F.max("total")).alias("peak"), F.count("*").alias("samples"))


@query("WITH e AS (SELECT n_nationkey AS k, n_nationkey % 4 + 1 AS v FROM nation WHERE n_nationkey <> 3), o AS (SELECT n_nationkey AS k, n_nationkey % 5 + 1 AS v FROM nation WHERE n_nationkey <> 7) SELECT coalesce(e.k, o.k) AS k, CASE WHEN o.v IS NULL THEN 'MISSING' WHEN e.v IS NULL THEN 'UNEXPECTED' WHEN e.v = o.v THEN 'MATCH' ELSE 'DIFFERENT' END AS verdict FROM e FULL OUTER JOIN o ON e.k = o.k")
def allocation_check(spark, d):
    """CMP-25."""
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    expected, observed = n.filter("k <> 3").withColumn("v", F.col("k") % 4 + 1), n.filter("k <> 7").withColumn("v", F.col("k") % 5 + 1)
    return audit.allocation(expected, observed, ["k"], "v").select("k", "verdict")


@query(f"WITH x AS (SELECT CAST(epoch_ms(ts) AS BIGINT) AS a, CAST(epoch_ms(ts) AS BIGINT) - event_id % 5000 AS b, event_id FROM events) SELECT count(*) AS n, count(*) FILTER (event_id % 50 = 0) AS missing, {s6('quantile_cont(CASE WHEN event_id % 50 <> 0 THEN a - b END, 0.5)')} AS p50, max(CASE WHEN event_id % 50 <> 0 THEN a - b END) AS longest FROM x")
def replay_latency(spark, d):
    """CMP-26: arrival less ingestion in milliseconds; rows without an ingestion time are counted."""
    e = load(spark, d, "events").withColumn("gap", F.when(F.col("event_id") % 50 != 0, F.floor(F.unix_micros("ts") / 1000) - (F.floor(F.unix_micros("ts") / 1000) - F.col("event_id") % 5000)))
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("gap").isNull()).alias("missing"), six(F.percentile("gap", 0.5)).alias("p50"), F.max("gap").alias("longest"))
