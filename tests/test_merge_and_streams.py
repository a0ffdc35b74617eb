"""Merges, writers and streams: replays, errors, restarts."""

import json

import pytest
from pyspark.sql import functions as F

from tidewright.operators import faults, quality
from tidewright.plans.medallion import raw
from tidewright.sources import merge, readers
from tidewright.streaming import listener, medallion

from .conftest import SF


def test_null_keys_match_and_replays_change_nothing(spark, tmp_path):
    schema = "k string, v int"
    rows = spark.createDataFrame([("a", 1), (None, 2)], schema)
    once = merge.merged(merge.empty(spark, schema), rows, ["k"])
    more = rows.withColumn("v", F.col("v") + 1)
    twice = merge.merged(merge.merged(once, more, ["k"]), more, ["k"])
    assert sorted((r.k or "", r.v) for r in twice.collect()) == [("", 3), ("a", 2)]
    assert [r.k for r in merge.without(twice, rows.filter("k is null"), ["k"]).collect()] == ["a"]
    for batch in (0, 1, 1):  # the last is a replay
        merge.write_changes(rows.withColumn("v", F.col("v") + batch), str(tmp_path / "t"), batch)
    assert sorted((r.k or "", r.v) for r in merge.newest(spark, str(tmp_path / "t"), schema, ["k"]).collect()) == [("", 3), ("a", 2)]


def test_two_source_rows_of_one_key_are_an_error(spark):
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError, match="several source rows"):
        merge.merged(merge.empty(spark, "k string, v int"), twice, ["k"])


def test_staged_write_moves_only_what_passes(spark, tmp_path):
    df = spark.range(5)

    def refuse(back):
        raise ValueError(back.count())

    with pytest.raises(ValueError, match="5"):
        merge.staged_write(df, str(tmp_path / "out"), refuse)
    assert not (tmp_path / "out").exists()
    merge.staged_write(df, str(tmp_path / "out"), lambda back: None)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    with pytest.raises(FileExistsError):
        merge.staged_write(df, str(tmp_path / "out"), lambda back: None)


def test_snapshot_sees_changes(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    first = readers.snapshot(spark, str(tmp_path / "a"))
    assert readers.snapshot(spark, str(tmp_path / "a")) == first
    spark.range(3).write.mode("append").parquet(str(tmp_path / "a"))
    assert readers.snapshot(spark, str(tmp_path / "a")) != first


def test_malformed_json_ends_with_the_dead_letters(spark):
    good = json.dumps({"event_id": "e", "location_id": "l", "latitude": 1.0, "longitude": 2.0, "event_time": "2024-01-01T00:00Z", "temperature_c": 20.0, "humidity_pct": 50.0, "precipitation_mm": 0.0})
    log = spark.createDataFrame([(1, good), (2, "{broken"), (3, None)], "offset long, payload string")
    ok, dead = quality.split_valid(medallion.parse(log), quality.valid_observation())
    assert [r.offset for r in ok.collect()] == [1]
    assert sorted(r.offset for r in dead.collect()) == [2, 3]


def test_late_rows_are_dropped_and_conserved(spark, tmp_path):
    """Arrival batches are files; a batch far behind the watermark adds nothing, and nothing else is lost."""
    hours = [("e%d" % i, i) for i in (0, 10, 20, 1, 21)]
    for k, (name, hour) in enumerate(hours):
        df = spark.createDataFrame([(name, 1_700_000_000 + hour * 3600)], "event_id string, s long").select("event_id", F.timestamp_seconds("s").alias("event_time"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = readers.file_stream(spark, str(tmp_path / "in"), "event_id string, event_time timestamp", 1)
    good, _ = medallion.silver(stream, F.lit(True), str(tmp_path), str(tmp_path / "state"))
    medallion.drain(good, _)
    kept = {r.event_id for r in spark.read.parquet(str(tmp_path / "silver")).collect()}
    assert kept == {"e0", "e10", "e20", "e21"}


def test_progress_log(spark, tmp_path):
    log = listener.ProgressLog(str(tmp_path / "log.jsonl"), "silver")
    spark.streams.addListener(log)
    try:
        spark.range(3).write.parquet(str(tmp_path / "in"))
        medallion.drain(medallion.append(readers.file_stream(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "out"), str(tmp_path / "cp")))
        for _ in range(100):
            if "query_terminated" in ((tmp_path / "log.jsonl").read_text() if (tmp_path / "log.jsonl").exists() else ""):
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    kinds = [x.event_type for x in readers.json_lines(spark, str(tmp_path / "log.jsonl")).collect()]
    assert kinds[0] == "query_started" and "query_progress" in kinds


def test_faults_are_seeded_and_conserve_rows(spark):
    base = raw(spark, SF).filter("copy = 0").drop("copy", "offset", "partition")
    one, two = (faults.replay(base, "event_id", seed=s) for s in (42, 43))
    assert one.exceptAll(faults.replay(base, "event_id", seed=42)).isEmpty()
    assert not one.exceptAll(two).isEmpty()
    assert one.filter("emission = 0").count() == base.count()
    assert one.filter("fault = 'DUPLICATE'").count() == one.filter("emission = 1").count()


def test_pushdown_and_pruning_reach_the_scan(spark, tmp_path):
    plan = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_quantity >= 49").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,49.0)]" in plan
    merge.overwrite_partitioned(spark.range(4).withColumn("split", F.when(F.col("id") < 2, "TRAIN").otherwise("TEST")), str(tmp_path / "p"), "split")
    plan = readers.partitioned(spark, str(tmp_path / "p"), ["id"], split="TRAIN")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_changes_are_compacted_without_changing_what_is_newest(spark, tmp_path):
    path, shape = str(tmp_path / "changes"), "k long, v long"
    for n in range(6):
        merge.write_changes(spark.range(n, n + 10).select(F.col("id").alias("k"), F.lit(n).cast("long").alias("v")), path, n)
    read = lambda: sorted(map(tuple, merge.newest(spark, path, shape, ["k"]).collect()))
    before = read()
    merge.compact(spark, path, shape, ["k"], 3)
    assert sorted(p.name for p in (tmp_path / "changes").glob("batch=*")) == ["batch=3", "batch=4", "batch=5"] and read() == before
    merge.compact(spark, path, shape, ["k"], 3)  # nothing to do
    merge.write_changes(spark.range(1).select(F.col("id").alias("k"), F.lit(9).cast("long").alias("v")), path, 6)
    assert read() == sorted([*((k, v) for k, v in before if k), (0, 9)])
    merge.newest(spark, path, shape, ["k"], 5).write.parquet(f"{path}/_compacted-5")  # as a run leaves it that broke off before the move
    merge.compact(spark, path, shape, ["k"], 5)
    assert sorted(p.name for p in (tmp_path / "changes").glob("*=*")) == ["batch=5", "batch=6"] and read() == sorted([*((k, v) for k, v in before if k), (0, 9)])
