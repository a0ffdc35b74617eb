"""Footers, versions of a change log, verified artefacts and tree ensembles as rows."""

import fnmatch
import re

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tidewright.operators import artefact, model
from tidewright.plans.artefact_slate import Line
from tidewright.sources import readers
from tidewright.sources.merge import write_changes
from tidewright.streaming import medallion as runs


def test_inventories_come_from_footers_and_leave_the_session_as_it_was(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 3).alias("p"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("a"), F.lit(None).cast("double").alias("b"), F.concat(F.lit("x"), "id").alias("c"))
    rows.repartition(4).write.partitionBy("p").parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    with readers.footers(spark):
        plan = readers._inventory(spark.read.parquet(str(tmp_path / "t")), ["p"], ["a"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedAggregation: \[.*COUNT\(\*\)", plan) and "PushedGroupBy: [p]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before and "parquet" in before
    told = {(r.p, r.column): (r.rows, r.nulls, r.least, r.most) for r in readers.inventory(spark, str(tmp_path / "t"), ["p"]).collect()}
    for p in range(3):
        mine = [i for i in range(1000) if i % 3 == p]
        there = [i for i in mine if i % 4]
        assert told[(p, "a")] == (len(mine), len(mine) - len(there), str(there[0]), str(there[-1]))
        assert told[(p, "b")] == (len(mine), len(mine), None, None) and told[(p, "c")] == (len(mine), 0, None, None)


def test_an_inventory_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "a long, b string").write.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in readers.inventory(spark, str(tmp_path / "t")).orderBy("column").collect()] == [(0, "a", 0, None, None), (0, "b", 0, None, None)]


@pytest.mark.parametrize("start", [-3, 0, 1, 9, 10, 37, 99, 100, 909, 1999])
def test_version_patterns_hold_all_later_versions_and_no_earlier_one(start):
    inner = readers.from_version(start)[len("batch={") : -1].split(",")
    for n in [*range(0, 2105), 10**6, 12345678]:
        assert any(fnmatch.fnmatchcase(str(n), p) for p in inner) == (n >= start), n


def test_a_stream_starts_at_its_version_and_goes_on_after_a_restart(spark, tmp_path):
    log = str(tmp_path / "log")
    for version in (0, 8, 9, 10):
        write_changes(spark.range(version * 10, version * 10 + 3), log, version)

    def run(start):
        runs.drain(runs.append(readers.change_stream(spark, log, "id long", start, 1), str(tmp_path / "out"), str(tmp_path / "state")))
        return sorted((r.batch, r.id) for r in spark.read.schema("id long, batch long").parquet(str(tmp_path / "out")).collect())

    first = run(9)
    assert first == [(v, v * 10 + k) for v in (9, 10) for k in range(3)]
    assert run(9) == first
    write_changes(spark.range(5), log, 123)
    assert run(9) == first + [(123, k) for k in range(5)]


def shipped(spark, tmp_path, name, content, sha256=None):
    (tmp_path / name).write_bytes(content)
    return artefact.ship(spark, str(tmp_path / name), sha256 or artefact.digest(content))


def test_a_worker_loads_a_proven_model_once(spark, tmp_path):
    made = shipped(spark, tmp_path, f"{tmp_path.name}-good.json", b'{"x": 2.0}')
    rows = spark.range(1000).select("id", F.col("id").cast("double").alias("x")).repartition(32)
    for _ in range(2):
        scored = artefact.score(rows, ["x"], made, Line, ["id"])
        assert all(r.prediction == 2.0 * r.id for r in scored.collect())
    assert 1 <= made.loads.value <= 4  # workers of local[4], in 64 tasks
    assert artefact.score(rows.limit(0), ["x"], made, Line, ["id"]).count() == 0


def test_a_changed_byte_stops_the_job(spark, tmp_path):
    agreed = artefact.digest(b'{"x": 2.0}')
    made = shipped(spark, tmp_path, f"{tmp_path.name}-bad.json", b'{"x": 3.0}', "0" + agreed[1:] if agreed[0] != "0" else "1" + agreed[1:])
    rows = spark.range(10).select("id", F.col("id").cast("double").alias("x"))
    with pytest.raises(PythonException, match="has the digest"):
        artefact.score(rows, ["x"], made, Line, ["id"]).collect()
    assert made.loads.value == 0


def test_importance_equals_a_walk_of_the_trees(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), F.lit(1.0).alias("same"), (F.col("id") * 2 + (F.col("id") % 7) * 40).cast("double").alias("y"))
    names = ["same", "x", "z"]
    fitted = model.fit(rows, names, "y", model.Candidate("a", 4, 3))
    fitted.write().save(str(tmp_path / "m"))
    count, gain = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)

    def walk(node):
        if "InternalNode" in node.getClass().getName():
            name = names[node.split().featureIndex()]
            count[name] += 1
            gain[name] += node.gain() * node.impurityStats().count()
            walk(node.leftChild())
            walk(node.rightChild())

    for tree in fitted.stages[-1].trees:
        walk(tree._call_java("rootNode"))
    told = model.importance(spark, str(tmp_path / "m"), names).collect()
    assert {r.feature: r.weight for r in told} == count and count["same"] == 0 and told[-1].feature == "same"
    for r in told:
        assert r.total_gain == pytest.approx(gain[r.feature]) and r.gain == pytest.approx(gain[r.feature] / max(1, count[r.feature]))
    assert [r.gain for r in told] == sorted((r.gain for r in told), reverse=True)
    leaves = model.nodes(spark, str(tmp_path / "m")).filter("feature is null")
    assert leaves.filter("left is not null or gain is not null").count() == 0 and leaves.groupBy("tree").agg(F.sum("rows").alias("n")).filter("n <> 300").count() == 0


def test_trees_stop_when_they_no_longer_help(spark):
    rows = spark.range(400).select(F.col("id").cast("double").alias("x"), F.rand(3).alias("noise"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0).alias("y"))
    fitted = model.fit_until(rows.filter("id % 4 < 2"), rows.filter("id % 4 >= 2"), ["noise"], "y", model.Candidate("a", 30, 3))
    assert fitted.stages[-1].getNumTrees < 30


def test_streams_stop_when_asked_and_keep_what_they_had(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    source = readers.file_stream(spark, str(tmp_path / "in"), "id long", 1)
    queries = [runs.append(source, str(tmp_path / f"out{k}"), str(tmp_path / f"state{k}"), seconds=1) for k in range(2)]
    asked = iter([False, True])
    runs.stop_when(queries, lambda: next(asked), poll_seconds=0.2)
    assert not any(q.isActive for q in queries)
    assert [spark.read.parquet(str(tmp_path / f"out{k}")).count() for k in range(2)] == [50, 50]
