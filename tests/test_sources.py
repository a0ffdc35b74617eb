"""File sources, gates of raw sets and centred metrics on small hand-made rows."""

import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewright.operators import gates, metrics
from tidewright.sources import readers
from tidewright.sources.merge import staged_write


def test_lines_are_numbered_over_blocks_of_a_file(spark, tmp_path):
    text = ["" if i % 7 == 0 else "{oops" if i % 50 == 0 else f'{{"a": {i}}}' for i in range(1, 1001)]
    for name, lines in (("one.json", text), ("two.json", ["{oops", ""]), ("none.json", [])):
        (tmp_path / name).write_text("".join(f"{line}\n" for line in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = readers.json_errors(spark, str(tmp_path), "a long")
        got = {(r.file.rsplit("/", 1)[1], r.line, r.text) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    wanted = {("one.json", i, "{oops") for i in range(50, 1001, 50) if i % 7}
    assert got == wanted | {("two.json", 1, "{oops")}


def test_catalog_refuses_repeated_and_invalid_places(spark, tmp_path):
    def written(name, rows):
        (tmp_path / name).write_text(rows)
        return str(tmp_path / name)

    place = '{"location_id": "a", "latitude": %s, "longitude": 1.0, "dataset_memberships": ["x"]}'
    good = written("good.json", f"[{place % 1.0}]")
    assert readers.catalog(spark, good, "x", expected=1).count() == 1
    for name, rows in (("twice.json", f"[{place % 1.0}, {place % 2.0}]"), ("far.json", f"[{place % 91.0}]")):
        with pytest.raises(ValueError, match="catalog"):
            readers.catalog(spark, written(name, rows))
    with pytest.raises(ValueError, match="instead of 2"):
        readers.catalog(spark, good, "x", expected=2)


def test_reports_do_not_replace_others(spark, tmp_path):
    path = str(tmp_path / "report")
    staged_write(spark.range(3), path, kind="json")
    assert spark.read.json(path).count() == 3
    with pytest.raises(FileExistsError):
        staged_write(spark.range(4), path, kind="json")


def test_raw_gates_of_an_empty_set_pass(spark):
    raw = spark.createDataFrame([], "event_id string, location_id string, event_time string, t double")
    known = spark.createDataFrame([("a",)], "location_id string")
    rows = gates.raw_gates(raw, known, F.col("t") > 0).collect()
    assert len(rows) == 10
    assert all(r.n == 0 and r.result == "PASS" for r in rows)
    year = gates.completeness(raw, known, [2024]).first()
    assert (year.rows, year.hours, year.missing_hours, year.affected) == (0, 0, 8784, True)


def test_raw_gates_count_nulls(spark):
    raw = spark.createDataFrame([(None, None, None, None), ("a_x", "a", "x", 1.0)], "event_id string, location_id string, event_time string, t double")
    known = spark.createDataFrame([("a",)], "location_id string")
    n = {r.gate: r.n for r in gates.raw_gates(raw, known, F.col("t") > 0).collect()}
    failing = {"event_id_missing", "location_id_missing", "event_time_missing", "event_id_differs", "measures_invalid", "time_malformed"}
    assert {gate for gate, count in n.items() if count} == failing
    assert set(n.values()) == {0, 1}


def test_a_centre_keeps_r2_of_large_means(spark):
    rows = [(1e9 + i + 0.5, 1e9 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "prediction double, reference double")
    sums = df.agg(*metrics.sufficient(centre=1e9))
    r = sums.select(*(v.alias(k) for k, v in metrics.regression().items())).first()
    assert r.r2 == pytest.approx(1 - 2.5 / 82.5)
    assert r.mae == pytest.approx(0.5)


@pytest.mark.parametrize("kind, make", [("long", int), ("decimal(38,2)", lambda x: Decimal(x).scaleb(-2)), ("double", lambda x: x / 4)])
def test_a_ledger_adds_up_what_is_in_reach(spark, kind, make):
    dice = random.Random(3)
    rows = [(i, dice.choice([None, dice.randrange(-200_000, 400_000), 86_400 * dice.randrange(4)]), dice.choice([None, make(dice.randrange(-9, 100))])) for i in range(400)]
    spans = {"second": 1, "hour": 3600, "day": 86_400, "long": 200_000}
    df = spark.createDataFrame(rows, f"id int, s long, units {kind}").withColumn("t", F.timestamp_seconds("s"))
    got = readers.call_units(df, "t", "units", spans)
    assert got.columns == [*df.columns, *spans] and got.count() == len(rows)
    for r in got.collect():
        for name, n in spans.items():
            near = [u for _, s, u in rows if u is not None and (s is None if r.s is None else s is not None and r.s - n < s <= r.s)]
            assert r[name] == (sum(near) if near else None)


def test_a_busy_day_of_a_ledger_is_one_pass(spark):
    n, start = 432_000, time.monotonic()  # 86,400 seconds of five; a sum over all before for each takes minutes
    df = spark.range(n).select("id", F.timestamp_seconds(F.col("id") % 86_400).alias("t"), F.lit(1).alias("units"))
    got = readers.call_units(df, "t", "units", {"day": 86_400}).agg(F.count("*").alias("rows"), F.max("day").alias("most"), F.min("day").alias("least")).first()
    assert (got.rows, got.most, got.least) == (n, n, 5)
    assert time.monotonic() - start < 60
