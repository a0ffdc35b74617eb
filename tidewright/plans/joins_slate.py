"""Queries: joins, sets, state (§2.4, 2.8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import haversine_km, six
from ..operators import joins, quality, state
from ..sources import readers
from .base import OBS, PANEL, load, observations, panel, query, s6, sec, seconds


@query("SELECT n_name, r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dim_lookup_broadcast(spark, d):
    """JON-01/09."""
    s = load(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    named = joins.lookup(s, load(spark, d, "nation"), ["n_nationkey"]).withColumnRenamed("n_regionkey", "r_regionkey")
    return joins.lookup(named, load(spark, d, "region"), ["r_regionkey"]).groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS known FROM customer")
def membership_flag(spark, d):
    """JON-02."""
    buyers = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.member_flag(load(spark, d, "customer"), buyers, ["c_custkey"]).select("c_custkey", "known")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def anti_chain(spark, d):
    """JON-05."""
    c = load(spark, d, "customer").select("c_custkey")
    return joins.without(c, load(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), load(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")), keys=["c_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def semi_filter(spark, d):
    """JON-03/15: the filter on quantity reaches the scan."""
    big = load(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").join(big, "o_orderkey", "left_semi")


CHANGED = "changed AS (SELECT location_id, event_time AS t FROM panel WHERE CAST(epoch(event_time) / 3600 AS BIGINT) % 97 = 0)"


@query(f"WITH {PANEL}, {CHANGED} SELECT DISTINCT p.location_id, {sec('p.event_time')} AS second FROM panel p JOIN changed c ON p.location_id = c.location_id AND p.event_time BETWEEN c.t AND c.t + INTERVAL 24 HOUR")
def range_dirty_join(spark, d):
    """JON-07, STR-11."""
    p = panel(spark, d)
    changed = p.filter(F.floor(F.unix_seconds("event_time") / 3600) % 97 == 0).select("location_id", "event_time")
    return joins.dirty_range(p.select("location_id", "event_time"), changed, "location_id", "event_time").select("location_id", seconds("event_time").alias("second"))


@query(f"WITH {PANEL}, a AS (SELECT location_id, event_time, temperature_c FROM panel WHERE CAST(epoch(event_time) / 3600 AS BIGINT) % 10 <> 0), b AS (SELECT location_id, event_time, CASE WHEN CAST(epoch(event_time) / 3600 AS BIGINT) % 7 = 0 THEN temperature_c + 1 ELSE temperature_c END AS temperature_c FROM panel WHERE CAST(epoch(event_time) / 3600 AS BIGINT) % 11 <> 0) SELECT count(*) FILTER (a.location_id IS NOT NULL AND b.location_id IS NOT NULL) AS matched, count(*) FILTER (b.location_id IS NULL) AS left_only, count(*) FILTER (a.location_id IS NULL) AS right_only, count(*) FILTER (abs(a.temperature_c - b.temperature_c) > 1e-8) AS mismatched, {s6('max(abs(a.temperature_c - b.temperature_c))')} AS max_abs_diff FROM a FULL OUTER JOIN b USING (location_id, event_time)")
def replay_full_outer(spark, d):
    """JON-16/19."""
    hour = F.floor(F.unix_seconds("event_time") / 3600)
    p = panel(spark, d).select("location_id", "event_time", "temperature_c")
    b = p.filter(hour % 11 != 0).withColumn("temperature_c", F.when(hour % 7 == 0, F.col("temperature_c") + 1).otherwise(F.col("temperature_c")))
    c = joins.compare(p.filter(hour % 10 != 0), b, ["location_id", "event_time"], ["temperature_c"])
    return c.withColumn("max_abs_diff", six(F.col("max_abs_diff")))


@query(f"WITH {PANEL}, st AS (SELECT * FROM panel WHERE event_time < TIMESTAMP '2024-01-20'), l AS (SELECT location_id, max(event_time) AS latest FROM st GROUP BY ALL) SELECT p.location_id, {sec('p.event_time')} AS second FROM panel p JOIN l USING (location_id) WHERE p.event_time < latest - INTERVAL 48 HOUR")
def state_latest_late(spark, d):
    """JON-06, STR-09."""
    p = panel(spark, d).select("location_id", "event_time")
    stored = p.filter(F.col("event_time") < F.to_timestamp(F.lit("2024-01-20")))
    return joins.late(p, stored, "location_id", "event_time").select("location_id", seconds("event_time").alias("second"))


@query(f"WITH {PANEL}, l AS (SELECT location_id, max(event_time) AS latest FROM panel GROUP BY ALL) SELECT location_id, {sec('event_time')} AS second FROM panel JOIN l USING (location_id) WHERE event_time < latest - INTERVAL 48 HOUR")
def state_expired(spark, d):
    """JON-17, SNK-05, STR-10."""
    return state.expired(panel(spark, d)).select("location_id", seconds("event_time").alias("second"))


ARRIVAL = "(event_id * 7919) % 1000003 * 100000 + event_id % 100000"


@query(f"WITH {OBS}, a AS (SELECT event_id, CAST(epoch_us(event_time) AS BIGINT) AS t, {ARRIVAL} AS arrival FROM obs), m AS (SELECT *, max(t) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a) SELECT event_id, greatest(0, coalesce(top - t, 0)) AS lag_micros, coalesce(top > (t // 3600000000 + 1) * 3600000000 + 600000000, false) AS late FROM m")
def arrival_lag_running_max(spark, d):
    """WIN-10/11: how far a row lags behind the latest time seen before it, without one task for all rows."""
    t = F.unix_micros("event_time")
    a = observations(spark, d).select("event_id", t.alias("t"), ((F.col("event_id") * 7919) % 1000003 * 100000 + F.col("event_id") % 100000).alias("arrival"))
    m = joins.running_max_before(a, "arrival", "t", "top")
    window_end = (F.floor(F.col("t") / 3600000000) + 1) * 3600000000
    return m.select("event_id", F.greatest(F.lit(0), F.coalesce(F.col("top") - F.col("t"), F.lit(0))).alias("lag_micros"), F.coalesce(F.col("top") > window_end + 600000000, F.lit(False)).alias("late"))


@query(f"WITH {OBS}, x AS (SELECT event_id, {ARRIVAL} AS arrival FROM obs) SELECT event_id, arrival FROM x ORDER BY arrival DESC, event_id LIMIT 20")
def top_lag(spark, d):
    """SRT-02."""
    return observations(spark, d).select("event_id", ((F.col("event_id") * 7919) % 1000003 * 100000 + F.col("event_id") % 100000).alias("arrival")).orderBy(F.col("arrival").desc(), "event_id").limit(20)


@query("SELECT o_custkey AS id, 'left' AS side FROM (SELECT o_custkey FROM orders EXCEPT SELECT p_partkey FROM part) UNION ALL SELECT p_partkey, 'right' FROM (SELECT p_partkey FROM part EXCEPT SELECT o_custkey FROM orders)")
def set_difference(spark, d):
    """SET-04."""
    a, b = load(spark, d, "orders").select(F.col("o_custkey").alias("id")), load(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return joins.differences(a, b, "id")


@query("SELECT 'orders' AS label, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def union_all_counts(spark, d):
    """SET-01/06."""
    out = None
    for t in ("orders", "lineitem", "events"):
        one = load(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 40")
def union_distinct(spark, d):
    """SET-02/03."""
    a = load(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return a.union(load(spark, d, "part").filter("p_size > 40").select("p_partkey")).dropDuplicates()


@query(f"WITH {PANEL}, h AS (SELECT event_time, count(DISTINCT location_id) AS present FROM panel GROUP BY ALL) SELECT {sec('max(event_time)')} AS common_second FROM h WHERE present = (SELECT count(DISTINCT location_id) FROM panel)")
def common_safe_hour(spark, d):
    """SET-05."""
    return joins.common_hour(panel(spark, d), "location_id", "event_time").select(seconds("common_hour").alias("common_second"))


def _km(a: str, b: str) -> str:
    return f"2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b}.la - {a}.la) / 2), 2) + cos(radians({a}.la)) * cos(radians({b}.la)) * pow(sin(radians({b}.lo - {a}.lo) / 2), 2))))"


@query(f"WITH p AS (SELECT n_nationkey AS k, 8.0::DOUBLE + n_nationkey * 0.6 AS la, 102.0::DOUBLE + (n_nationkey * 7) % 8 AS lo FROM nation) SELECT a.k AS a, b.k AS b, {s6(_km('a', 'b'))} AS km FROM p a JOIN p b ON b.k = a.k + 1")
def haversine(spark, d):
    """§2.9 math."""
    p = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (8.0 + F.col("n_nationkey") * 0.6).alias("la"), (102.0 + (F.col("n_nationkey") * 7) % 8).alias("lo"))
    b = p.select((F.col("k") - 1).alias("k"), F.col("la").alias("la2"), F.col("lo").alias("lo2"))
    return p.join(b, "k").select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"), six(haversine_km(F.col("la"), F.col("lo"), F.col("la2"), F.col("lo2"))).alias("km"))


@query(f"WITH {OBS} SELECT event_id, user_id, CAST(sum(humidity_pct) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(event_time)) AS BIGINT) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS BIGINT) AS day_units FROM obs")
def quota_units(spark, d):
    """SRC-18, the analytic part: units in the trailing day by key, by range."""
    o = observations(spark, d).select("event_id", "user_id", "event_time", F.col("humidity_pct").cast("long").alias("units"))
    w = Window.partitionBy("user_id").orderBy(F.unix_seconds("event_time")).rangeBetween(-86399, 0)
    return o.select("event_id", "user_id", F.sum("units").over(w).alias("day_units"))


@query(f"WITH {OBS} SELECT event_id, CAST(sum(humidity_pct) OVER (ORDER BY CAST(floor(epoch(event_time)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS BIGINT) AS hour_units, CAST(sum(humidity_pct) OVER (ORDER BY CAST(floor(epoch(event_time)) AS BIGINT) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS BIGINT) AS day_units FROM obs")
def quota_ledger(spark, d):
    """SRC-18: a ledger without a key, in day buckets that carry in what is still in reach."""
    o = observations(spark, d).select("event_id", "event_time", F.col("humidity_pct").cast("long").alias("units"))
    return readers.call_units(o, "event_time", "units", {"hour_units": 3600, "day_units": 86400}).select("event_id", "hour_units", "day_units")


@query(f"WITH {OBS}, lo AS (SELECT location_id, count(*) AS n FROM obs GROUP BY ALL) SELECT min(n) AS least, max(n) AS most, count(*) AS locations FROM lo")
def nested_min_max(spark, d):
    """AGG-30."""
    return observations(spark, d).groupBy("location_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("locations"))


_HOUR = "CAST(epoch(event_time) / 3600 AS BIGINT)"
_REACH = "OVER (PARTITION BY location_id ORDER BY CAST(floor(epoch(event_time)) AS BIGINT) RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)"
#: Every 67th hour has payloads that differ and every 71st a value that is not valid; each hour's next one is asked for.
STATUS = f"""s AS (SELECT location_id, event_time, {_HOUR} % 67 = 0 AS clash, row_number() OVER (PARTITION BY location_id ORDER BY event_time) AS r, count(*) {_REACH} AS seen,
  max(CASE WHEN {_HOUR} % 67 = 0 THEN 1 ELSE 0 END) {_REACH} AS clashes, max(CASE WHEN {_HOUR} % 71 = 0 THEN 1 ELSE 0 END) {_REACH} AS faults FROM panel),
status AS (SELECT location_id, event_time, CASE WHEN clash THEN 'DUPLICATE_CONFLICT' WHEN r <= 6 THEN 'INSUFFICIENT_HISTORY' WHEN seen < 7 THEN 'HISTORY_GAP' WHEN clashes = 1 THEN 'DUPLICATE_CONFLICT'
  WHEN faults = 1 THEN 'INVALID_FEATURES' ELSE 'READY' END AS status FROM s
  UNION ALL SELECT location_id, event_time + INTERVAL 1 HOUR, 'CURRENT_OBSERVATION_MISSING' FROM panel WHERE (location_id, event_time + INTERVAL 1 HOUR) NOT IN (SELECT (location_id, event_time) FROM panel))"""


def _status(spark, d):
    p, hour = panel(spark, d), F.floor(F.unix_seconds("event_time") / 3600)
    asked = p.select("location_id", (F.col("event_time") + F.expr("INTERVAL 1 HOUR")).alias("event_time"))
    return state.observed_status(p, valid=hour % 71 != 0, depth=6, conflicts=p.filter(hour % 67 == 0), asked=asked)


@query(f"WITH {PANEL}, {STATUS} SELECT location_id, {sec('event_time')} AS second, status FROM status")
def observation_status(spark, d):
    """CMP-06, WIN-14 with a look-back of 6 hours: all six statuses."""
    return _status(spark, d).select("location_id", seconds("event_time").alias("second"), "status")


@query(f"WITH {PANEL}, {STATUS} SELECT location_id, {sec('event_time')} AS second, CASE WHEN status = 'HISTORY_GAP' THEN 'GAP_IN_HISTORY' WHEN status <> 'READY' THEN status WHEN {_HOUR} % 41 = 0 THEN 'INVALID_PROVENANCE' WHEN {_HOUR} % 2 = 0 AND event_time + INTERVAL 2 HOUR <= TIMESTAMP '2024-01-20' THEN 'NON_PROSPECTIVE_SKIPPED' ELSE 'READY' END AS outcome FROM status")
def prospective_outcomes(spark, d):
    """CMP-07: every second hour is live, every 41st has another source."""
    hour, target = F.floor(F.unix_seconds("event_time") / 3600), F.col("event_time") + F.expr("INTERVAL 2 HOURS")
    outcome = state.prospective_status(F.col("status"), target, F.to_timestamp(F.lit("2024-01-20")), hour % 41 != 0, hour % 2 == 0)
    return _status(spark, d).select("location_id", seconds("event_time").alias("second"), outcome.alias("outcome"))


@query(f"WITH {PANEL}, p AS (SELECT * FROM panel UNION ALL SELECT * FROM panel WHERE {_HOUR} % 97 = 0) SELECT (SELECT count(*) FROM (SELECT 1 FROM p GROUP BY location_id, event_time HAVING count(*) > 1)) AS duplicate_keys, count(*) AS total_rows, count(*) FILTER (temperature_c IS NULL) AS null_temperature_c, count(DISTINCT location_id) AS keys, {sec('min(event_time)')} AS first_second, {sec('max(event_time)')} AS last_second FROM p")
def source_gate(spark, d):
    """CMP-03 over a panel with repeated keys."""
    p = panel(spark, d)
    gate = quality.source_gate(p.unionByName(p.filter(F.floor(F.unix_seconds("event_time") / 3600) % 97 == 0)), "location_id", "event_time", ["temperature_c"])
    return gate.select("duplicate_keys", "total_rows", "null_temperature_c", "keys", seconds("first_time").alias("first_second"), seconds("last_time").alias("last_second"))


@query(f"WITH {PANEL}, {CHANGED}, dirty AS (SELECT DISTINCT p.location_id, p.event_time FROM panel p JOIN changed c ON p.location_id = c.location_id AND p.event_time BETWEEN c.t AND c.t + INTERVAL 24 HOUR) SELECT p.location_id, {sec('p.event_time')} AS second, d.location_id IS NOT NULL AS candidate FROM panel p LEFT JOIN dirty d USING (location_id, event_time)")
def candidate_mark(spark, d):
    """JON-08: all history with a mark on the hours to score again."""
    p = panel(spark, d).select("location_id", "event_time")
    changed = p.filter(F.floor(F.unix_seconds("event_time") / 3600) % 97 == 0)
    dirty = joins.dirty_range(p, changed, "location_id", "event_time").withColumn("candidate", F.lit(True))
    marked = p.join(dirty, ["location_id", "event_time"], "left")
    return marked.select("location_id", seconds("event_time").alias("second"), F.coalesce("candidate", F.lit(False)).alias("candidate"))


@query(f"WITH {OBS} SELECT count(*) = 0 AS empty_before, EXISTS (SELECT 1 FROM obs WHERE humidity_pct > 98) AS found FROM obs WHERE event_id < 0")
def existence_probes(spark, d):
    """SRT-04/05."""
    o = observations(spark, d)
    empty, found = o.filter("event_id < 0").isEmpty(), not o.filter("humidity_pct > 98").isEmpty()
    return spark.createDataFrame([(empty, found)], "empty_before boolean, found boolean")


@query(f"WITH {OBS} SELECT count(*) FILTER (v IS NOT TRUE) AS strict_violations, count(*) FILTER (NOT v) AS lax_violations FROM (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE temperature_c > 0 END AS v FROM obs)")
def strict_violations(spark, d):
    """FLT-11: null validity is a violation; counting only false ones would miss it."""
    v = F.when(F.col("event_id") % 11 != 0, F.col("temperature_c") > 0)
    return observations(spark, d).select(v.alias("v")).agg(F.count_if(~F.coalesce("v", F.lit(False))).alias("strict_violations"), F.count_if(~F.col("v")).alias("lax_violations"))
