"""Vectors by exact time, presence bitmaps and fingerprints on small hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.operators import features, presence, reconcile, vectors

UTC = dt.timezone.utc


def panel_rows(spark, present, key="a"):
    rows = [(key, h * 3600, float(h), 50.0 + h % 7, 1000.0 + h % 5, 0.5, 3.0, 4.0, 10.0, 105.0) for h in present]
    names = "location_id string, s long, temperature_c double, humidity_pct double, pressure_hpa double, precipitation_mm double, wind_speed_kmh double, wind_gust_kmh double, latitude double, longitude double"
    return spark.createDataFrame(rows, names).withColumn("event_time", F.timestamp_seconds("s"))


def test_slots_are_filled_by_time_and_named_where_absent(spark):
    made = vectors.with_slots(panel_rows(spark, [0, 1, 2, 4, 5, 9]), "location_id", "event_time", ["temperature_c"], 4)
    rows = {r.s // 3600: r for r in made.select("s", "slots", vectors.absent("slots", 4).alias("absent"), vectors.slot_map("temperature_c", "slots", 4).alias("m")).collect()}
    assert [x and x.temperature_c for x in rows[5].slots] == [5.0, 4.0, None, 2.0, 1.0]
    assert rows[5].absent == ["t-2h"] and rows[5].m == {"t-0h": 5.0, "t-1h": 4.0, "t-3h": 2.0, "t-4h": 1.0}
    assert rows[9].absent == ["t-1h", "t-2h", "t-3h"] and rows[4].absent == ["t-1h"] and rows[0].absent == ["t-1h", "t-2h", "t-3h", "t-4h"]


def test_a_null_value_is_not_an_absent_row_and_rows_off_the_hour_fill_nothing(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1800, 7.0), ("a", 3600, 1.0)], "k string, s long, v double").withColumn("t", F.timestamp_seconds("s"))
    row = vectors.with_slots(df, "k", "t", ["v"], 1).filter("s = 3600").select("slots", vectors.absent("slots", 1).alias("absent")).first()
    assert row.slots[1] is not None and row.slots[1].v is None and row.absent == []


def test_positions_are_fooled_where_slots_are_not(spark):
    twice = [*range(0, 10), *range(11, 26)]  # hour 10 lacks
    made = vectors.online_vectors(panel_rows(spark, twice)).filter(F.unix_seconds("event_time") == 25 * 3600).first()
    assert made.status == "HISTORY_GAP" and made.absent == ["t-15h"]
    assert made.temp_lag_24h == 1.0 and made.temp_lag_12h == 13.0 and made.temp_roll_mean_24h is None and made.temp_roll_mean_6h == pytest.approx(22.5)
    by_position = panel_rows(spark, twice).select("s", features.lagged(features.Panel())["temp_lag_24h"].alias("x")).filter("s = 25 * 3600").first()
    assert by_position.x == 0.0


def test_whole_histories_equal_positions_in_all_features(spark):
    rows = panel_rows(spark, range(60))
    online = vectors.online_vectors(rows)
    assert {r.status: r["count"] for r in online.groupBy("status").count().collect()} == {"INSUFFICIENT_HISTORY": 24, "READY": 36}
    offline = features.build(rows)
    told = vectors.parity(online, offline, ["location_id", "event_time"], features.columns()).collect()
    assert len(told) == 73 and all(r.rows == 35 and r.different == 0 for r in told)


def test_values_that_are_not_finite_are_invalid(spark):
    rows = panel_rows(spark, range(26)).withColumn("humidity_pct", F.when(F.col("s") == 3 * 3600, float("nan")).otherwise(F.col("humidity_pct")))
    assert vectors.online_vectors(rows).filter(F.unix_seconds("event_time") >= 24 * 3600).select("status").distinct().first().status == "INVALID_FEATURES"


def covered(spark, hours, years, known=("a",)):
    """hours: of key a, or by key."""
    by_key = hours if isinstance(hours, dict) else {"a": hours}
    df = spark.createDataFrame([(k, int(h.timestamp())) for k, hs in by_key.items() for h in hs], "k string, s long").withColumn("t", F.timestamp_seconds("s"))
    rows = presence.coverage(presence.presence(df, "k", "t"), "k", spark.createDataFrame([(k,) for k in known], "k string"), years)
    return {(r.k, r.year): (r.rows, r.hours, r.missing_hours, *(x and int(x) for x in (r.a, r.b)), r.affected) for r in rows.select("*", F.unix_seconds("first_missing").alias("a"), F.unix_seconds("last_missing").alias("b")).collect()}


def every(year):
    start, end = dt.datetime(year, 1, 1, tzinfo=UTC), dt.datetime(year + 1, 1, 1, tzinfo=UTC)
    return [start + dt.timedelta(hours=h) for h in range(int((end - start).total_seconds() // 3600))]


@pytest.mark.parametrize("year", [2023, 2024])
def test_bits_tell_the_first_and_last_missing_hour(spark, year):
    hours, lost = every(year), [[], [0], [-1], [0, -1], [7], [8], [15, 16], [4321], [100, 8000], list(range(24)), [*range(3, 11), -9, -8]]
    there, want = {}, {}
    for k, some in enumerate(lost):
        gone = sorted(hours[i] for i in some)
        there[str(k)] = [h for h in hours if h not in gone]
        ends = [int(g.timestamp()) for g in (gone[0], gone[-1])] if gone else [None, None]
        want[str(k), year] = (len(there[str(k)]), len(there[str(k)]), len(gone), *ends, bool(gone))
    assert covered(spark, there, [year], tuple(there)) == want


def test_years_and_places_without_rows_lack_everything(spark):
    start, end = int(dt.datetime(2024, 1, 1, tzinfo=UTC).timestamp()), int(dt.datetime(2024, 12, 31, 23, tzinfo=UTC).timestamp())
    told = covered(spark, [every(2023)[5]] * 3, [2023, 2024], ("a", "b"))
    assert told[("a", 2023)][:3] == (3, 1, 8759) and told[("a", 2024)] == (0, 0, 8784, start, end, True) and told[("b", 2023)][:3] == (0, 0, 8760)


def test_merged_bitmaps_are_those_of_all_rows(spark):
    df = spark.createDataFrame([("a", h * 3600 * 7) for h in range(300)] + [("b", 0), (None, 0), ("b", 1800)], "k string, s long").withColumn("t", F.timestamp_seconds("s"))
    parts = [presence.presence(df.filter(F.col("s") % 2 == k), "k", "t") for k in range(2)]
    both = presence.merged(parts[0].unionByName(parts[1]).unionByName(parts[0].limit(0)), "k")
    show = lambda p: sorted((r.k, r.year, bytes(r.bitmap), r.rows) for r in p.collect())
    assert show(both) == show(presence.presence(df, "k", "t"))
    plan = presence.coverage(both, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert presence.missing_gate(presence.coverage(both.limit(0), "k")).first().asDict() == {"gate": "hours_missing", "n": 0, "result": "PASS"}


LEFT = [("g", 1, "a", 1.0), ("g", 2, None, 1.0), ("g", 3, "c", None), ("g", 4, "d", 4.0), ("g", 4, "d", 4.0), ("h", 5, "e", 5.0), (None, 6, "f", 6.0), (None, None, "n", 0.0), ("k", 9, "x", 9.0), ("g", 8, "p", 1.0), ("g", 8, "q", 2.0)]
RIGHT = [("g", 1, "a", 1.0), ("g", 2, "1.0", None), ("g", 3, "c", 0.0), ("g", 4, "d", 4.0), ("h", 5, "e", 5.0), (None, 6, "f", 7.0), (None, None, "n", 0.0), (None, None, "n", 0.0), ("new", 7, "z", 7.0), ("g", 8, "q", 2.0), ("g", 8, "p", 1.0)]


def test_reconciliation_finds_each_kind_of_fault_and_nothing_else(spark):
    shape = "part string, id long, a string, v double"
    left, right = spark.createDataFrame(LEFT, shape), spark.createDataFrame(RIGHT, shape)
    told = {(r.part, r.id): (r.left_n, r.right_n, r.verdict) for r in reconcile.reconcile(left, right, ["part"], ["id"], ["a", "v"]).collect()}
    assert told == {
        ("g", 2): (1, 1, "CHANGED"), ("g", 3): (1, 1, "CHANGED"), ("g", 4): (2, 1, "REPEATED"), (None, 6): (1, 1, "CHANGED"),
        (None, None): (1, 2, "REPEATED"), ("k", 9): (1, 0, "LOST"), ("new", 7): (0, 1, "UNEXPECTED"),
    }
    groups = {r.part: (r.left_n, r.right_n, r.differs) for r in reconcile.compare_groups(*(reconcile.fingerprints(x, ["part"], ["id", "a", "v"]) for x in (left, right)), ["part"]).collect()}
    assert groups == {"g": (7, 6, True), "h": (1, 1, False), None: (2, 3, True), "k": (1, 0, True), "new": (0, 1, True)}
    assert reconcile.reconcile(left, left.orderBy("v"), ["part"], ["id"], ["a", "v"]).count() == 0
    assert reconcile.reconcile(left.limit(0), left.limit(0), ["part"], ["id"], ["a", "v"]).count() == 0


def test_rows_swapped_between_copies_of_a_key_are_seen(spark):
    shape = "part string, id long, v double"
    a = spark.createDataFrame([("g", 1, 1.0), ("g", 1, 1.0), ("g", 1, 2.0)], shape)
    b = spark.createDataFrame([("g", 1, 1.0), ("g", 1, 2.0), ("g", 1, 2.0)], shape)
    assert [r.verdict for r in reconcile.reconcile(a, b, ["part"], ["id"], ["v"]).collect()] == ["REPEATED"]


def test_fingerprints_of_parts_add_up(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.sqrt("id").alias("v"))
    whole = reconcile.fingerprints(df, ["g"], ["id", "v"])
    parts = reconcile.fingerprints(df.filter("id % 2 = 0"), ["g"], ["id", "v"]).unionByName(reconcile.fingerprints(df.filter("id % 2 = 1"), ["g"], ["id", "v"]))
    assert not any(r.differs for r in reconcile.compare_groups(whole, reconcile.added(parts, ["g"]), ["g"]).collect())
