"""Queries: vectors by exact time, presence bitmaps, reconciliation by fingerprints (§2.7, 2.9, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import six
from ..functions.times import aligned, parse_instant
from ..operators import features, presence, reconcile, vectors
from .base import PANEL, load, panel, query, s6, sec, seconds
from .source_slate import RAW_TEXT, _places, raw_text


def _slot_sql() -> str:
    """Every feature of the contract over rows joined by exact time: k hours back."""
    at = lambda c, n: f"max({c}) FILTER (k = {n})"
    out = [f"{at(c, n)} AS {short}_lag_{n}h" for c, (short, ns) in features.LAGS.items() for n in ns]
    names = {"mean": "avg", "std": "stddev_pop", "sum": "sum"}
    for c, (short, operations) in features.ROLLS.items():
        for n in features.ROLL_HOURS:
            for op in operations:
                name = f"{short}_sum_{n}h" if op == "sum" else f"{short}_roll_{op}_{n}h"
                out.append(s6(f"CASE WHEN count({c}) FILTER (k < {n}) = {n} THEN {names[op]}({c}) FILTER (k < {n}) END") + f" AS {name}")
    out += [s6(f"{at(c, 0)} - {at(c, n)}") + f" AS {short}_delta_{n}h" for c, short, ns in features.DELTAS for n in ns]
    return ",\n  ".join(out)


SLOTS = """slots AS (SELECT p.location_id, p.event_time, p.earlier, k, q.* EXCLUDE (location_id, event_time), q.location_id IS NOT NULL AS there
  FROM (SELECT location_id, event_time, row_number() OVER (PARTITION BY location_id ORDER BY event_time) - 1 AS earlier FROM panel) p, range(25) t(k)
  LEFT JOIN panel q ON q.location_id = p.location_id AND q.event_time = p.event_time - k * INTERVAL 1 HOUR)"""


@query(f"""WITH {PANEL}, {SLOTS} SELECT location_id, {sec('event_time')} AS second,
  CASE WHEN any_value(earlier) < 24 THEN 'INSUFFICIENT_HISTORY' WHEN count(*) FILTER (there) < 25 THEN 'HISTORY_GAP' ELSE 'READY' END AS status,
  coalesce(string_agg('t-' || k || 'h', ';' ORDER BY k) FILTER (NOT there), '') AS absent,
  {_slot_sql()}
FROM slots GROUP BY location_id, event_time""")
def exact_vectors(spark, d):
    """WIN-14: slots by hours of difference, those without a row by name, and all features that have the slots they need."""
    made = vectors.online_vectors(panel(spark, d).withColumns({"latitude": F.lit(10.0), "longitude": F.lit(105.0)}))
    names = list(vectors.slot_features())
    shown = [F.col(c) if "_lag_" in c else six(F.col(c)).alias(c) for c in names]
    return made.select("location_id", seconds("event_time").alias("second"), "status", F.array_join("absent", ";").alias("absent"), *shown)


#: Features of the last six hours.
NEAR = [n for n in features.columns() if any(f"_{part}_" in n for part in ("lag", "roll", "sum", "delta")) and not n.endswith(("_12h", "_24h"))]


@query(f"""WITH {PANEL}, {SLOTS}, whole AS (SELECT location_id, event_time FROM slots WHERE k <= 6 GROUP BY ALL HAVING count(*) FILTER (there) = 7),
names AS (SELECT unnest({NEAR}) AS feature)
SELECT feature, count(whole.location_id) AS rows, CAST(0 AS BIGINT) AS "different" FROM names LEFT JOIN whole ON true GROUP BY feature""")
def online_offline_parity(spark, d):
    """WIN-14, JON-19: where the last six hours are whole, slots by time and lags by position agree in every feature they reach."""
    short = {c: (s, tuple(n for n in ns if n <= 6)) for c, (s, ns) in features.LAGS.items()}
    p = features.Panel(depth=6, lags=short, roll_hours=(3, 6))
    rows = panel(spark, d).withColumns({"latitude": F.lit(10.0), "longitude": F.lit(105.0)})
    online = vectors.with_slots(rows, "location_id", "event_time", list(features.CURRENT), 6).filter(F.size(vectors.absent("slots", 6)) == 0)
    made = vectors.slot_features(p)
    online = online.select("location_id", "event_time", *(made[n].alias(n) for n in NEAR))
    by_position = features.lagged(p) | features.rolled(p) | features.differences(p)
    offline = rows.select("location_id", "event_time", *(by_position[n].alias(n) for n in NEAR))
    return vectors.parity(online, offline, ["location_id", "event_time"], NEAR)


YEARS = (2023, 2024)
COVERED = f"""{RAW_TEXT}, f AS (SELECT DISTINCT location_id, hour FROM judged WHERE known AND NOT malformed AND NOT off_hour),
every AS (SELECT l AS location_id, y AS year, unnest(generate_series(make_timestamp(y, 1, 1, 0, 0, 0), make_timestamp(y, 12, 31, 23, 0, 0), INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT event_type AS l FROM events), (VALUES (2023), (2024)) t(y)),
lacks AS (SELECT e.*, f.hour IS NULL AS lacks FROM every e LEFT JOIN f USING (location_id, hour)),
n AS (SELECT location_id, year(hour) AS year, count(*) AS rows FROM judged WHERE known AND NOT malformed AND NOT off_hour GROUP BY ALL),
covered AS (SELECT location_id, year, count(*) FILTER (NOT lacks) AS hours, count(*) FILTER (lacks) AS missing_hours, min(hour) FILTER (lacks) AS first_missing, max(hour) FILTER (lacks) AS last_missing FROM lacks GROUP BY ALL)"""


def _covered(spark, d):
    """Bitmaps of two halves of the rows, merged."""
    raw = raw_text(spark, d).withColumn("at", parse_instant(F.col("event_time"))).join(F.broadcast(_places(spark, d)), "location_id", "left_semi")
    sound = raw.filter(aligned(F.col("at")))
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    halves = [presence.presence(sound.filter(half == k), "location_id", "at") for k in range(2)]
    return presence.coverage(presence.merged(halves[0].unionByName(halves[1]), "location_id"), "location_id", _places(spark, d), list(YEARS))


@query(f"WITH {COVERED} SELECT location_id, CAST(year AS INTEGER) AS year, coalesce(rows, 0) AS rows, hours, missing_hours, {sec('first_missing')} AS first_missing, {sec('last_missing')} AS last_missing, missing_hours > 0 AS affected FROM covered LEFT JOIN n USING (location_id, year)")
def raw_presence(spark, d):
    """CMP-17, SET-07: hours of each place and year from bitmaps, with the first and last that lack."""
    c = _covered(spark, d)
    return c.select("location_id", "year", "rows", "hours", "missing_hours", seconds("first_missing").alias("first_missing"), seconds("last_missing").alias("last_missing"), "affected")


@query(f"WITH {COVERED} SELECT 'hours_missing' AS gate, CAST(sum(missing_hours) AS BIGINT) AS n, CASE WHEN sum(missing_hours) = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM covered")
def raw_missing_gate(spark, d):
    """CMP-17: the eleventh gate."""
    return presence.missing_gate(_covered(spark, d))


@query(f"WITH {COVERED} SELECT CAST(year AS INTEGER) AS year, CAST(sum(missing_hours) AS BIGINT) AS missing_hours, coalesce(string_agg(location_id, ';' ORDER BY location_id) FILTER (missing_hours > 0), '') AS affected FROM covered GROUP BY year")
def raw_affected_places(spark, d):
    """CMP-17: the places of each year that lack hours."""
    a = presence.affected_keys(_covered(spark, d), "location_id")
    return a.select("year", "missing_hours", F.array_join("affected", ";").alias("affected"))


#: A load with faults in some days alone: lost, repeated, changed and unexpected rows, one of them by a null.
LOADED = """src AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, user_id, value FROM events),
loaded AS (SELECT event_id, event_type, day, user_id, CASE WHEN day(day) % 5 = 0 AND event_id % 31 = 0 THEN value + 1 WHEN day(day) % 5 = 0 AND event_id % 37 = 0 THEN NULL ELSE value END AS value
  FROM src WHERE NOT (day(day) % 5 = 1 AND event_id % 29 = 0)
  UNION ALL SELECT * FROM src WHERE day(day) % 5 = 2 AND event_id % 41 = 0 UNION ALL SELECT -event_id - 1, event_type, day, user_id, value FROM src WHERE day(day) % 5 = 2 AND event_id % 43 = 0)"""


def _loaded(spark, d):
    src = load(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), "user_id", "value")
    k, i = F.dayofmonth("day") % 5, F.col("event_id")
    value = F.when((k == 0) & (i % 31 == 0), F.col("value") + 1).when((k == 0) & (i % 37 == 0), None).otherwise(F.col("value"))
    loaded = src.filter(~((k == 1) & (i % 29 == 0))).withColumn("value", value)
    return src, loaded.unionByName(src.filter((k == 2) & (i % 41 == 0))).unionByName(src.filter((k == 2) & (i % 43 == 0)).withColumn("event_id", -i - 1))


ROW = ["event_id", "user_id", "value"]


@query(f"""WITH {LOADED}, a AS (SELECT event_type, day, count(*) AS left_n FROM src GROUP BY ALL), b AS (SELECT event_type, day, count(*) AS right_n FROM loaded GROUP BY ALL),
x AS (SELECT * FROM src EXCEPT ALL SELECT * FROM loaded), y AS (SELECT * FROM loaded EXCEPT ALL SELECT * FROM src),
diff AS (SELECT DISTINCT event_type, day FROM (SELECT event_type, day FROM x UNION ALL SELECT event_type, day FROM y))
SELECT event_type, CAST(day AS VARCHAR) AS day, coalesce(left_n, 0) AS left_n, coalesce(right_n, 0) AS right_n, diff.day IS NOT NULL AS differs FROM a FULL OUTER JOIN b USING (event_type, day) LEFT JOIN diff USING (event_type, day)""")
def load_groups(spark, d):
    """CMP-16: multisets of rows by event type and day, compared by digests; the loaded side's are added up from two parts."""
    src, loaded = _loaded(spark, d)
    by = ["event_type", "day"]
    parts = [reconcile.fingerprints(loaded.filter(F.pmod("event_id", F.lit(2)) == k), by, ROW) for k in range(2)]
    groups = reconcile.compare_groups(reconcile.fingerprints(src, by, ROW), reconcile.added(parts[0].unionByName(parts[1]), by), by)
    return groups.select("event_type", F.col("day").cast("string").alias("day"), "left_n", "right_n", "differs")


@query(f"""WITH {LOADED}, a AS (SELECT event_type, day, event_id, count(*) AS n, list_sort(list_distinct(list(coalesce(CAST(value AS VARCHAR), 'null')))) AS v, any_value(user_id) AS u FROM src GROUP BY ALL),
b AS (SELECT event_type, day, event_id, count(*) AS n, list_sort(list_distinct(list(coalesce(CAST(value AS VARCHAR), 'null')))) AS v, any_value(user_id) AS u FROM loaded GROUP BY ALL)
SELECT event_type, CAST(day AS VARCHAR) AS day, event_id, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n,
  CASE WHEN b.n IS NULL THEN 'LOST' WHEN a.n IS NULL THEN 'UNEXPECTED' WHEN a.v = b.v THEN 'REPEATED' ELSE 'CHANGED' END AS verdict
FROM a FULL OUTER JOIN b USING (event_type, day, event_id) WHERE a.n IS NULL OR b.n IS NULL OR a.n <> b.n OR a.v <> b.v""")
def load_reconciliation(spark, d):
    """CMP-16: planted lost, repeated, changed and unexpected rows, found in the groups that differ."""
    src, loaded = _loaded(spark, d)
    found = reconcile.reconcile(src, loaded, ["event_type", "day"], ["event_id"], ROW)
    return found.select("event_type", F.col("day").cast("string").alias("day"), "event_id", "left_n", "right_n", "verdict")
