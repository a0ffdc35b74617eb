"""Moving windows of quantile sketches: exact covers, ranks within the bound, and records that use them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import sketches
from tidewright.operators.records import metric_records
from tidewright.plans.base import QUERIES
from tidewright.plans.record_slate import rated

from .conftest import SF


@pytest.mark.parametrize("span", [1, 2, 6, 24, 168])
def test_covers_hold_each_hour_of_a_window_once(spark, span):
    ends = spark.range(-20, 400).select(F.col("id").alias("end"))
    for r in ends.select("end", sketches.cover(F.col("end"), span).alias("blocks")).collect():
        hours = [h for b in r.blocks for h in range(b.block << b.level, (b.block + 1) << b.level)]
        assert sorted(hours) == list(range(r.end - span + 1, r.end + 1))
        assert len(r.blocks) <= 2 * sketches.levels(span)


def made(spark, n=20_000):
    dice = random.Random(5)
    rows = [("a" if i % 3 else "b", dice.randrange(200) * 3600 + dice.randrange(3600), dice.choice([dice.gauss(0, 10), float(dice.randrange(5))])) for i in range(n)]
    rows += [("a", 100, float("nan")), ("a", 100, float("inf")), ("a", 100, None), ("c", 50, None)]
    return rows, spark.createDataFrame(rows, "k string, s long, v double").withColumn("t", F.timestamp_seconds("s"))


def test_windows_have_the_counts_sums_and_ranks_of_their_values(spark):
    rows, df = made(spark)
    hours = sketches.hourly(df, ["k"], "t", "v", k=100)
    merged = sketches.blocks(hours, ["k"], 24, k=100)
    ends = spark.createDataFrame([(k, e) for k in "abc" for e in (0, 30, 77, 199, 500)], "k string, end long")
    shares = (0.0, 0.05, 0.5, 0.95, 1.0)
    found = sketches.windows(merged, ["k"], ends, 24, k=100).select("*", *(sketches.quantile(s).alias(f"q{i}") for i, s in enumerate(shares))).collect()
    assert {(r.k, r.end) for r in found} == {(k, e) for k in "ab" for e in (0, 30, 77, 199)}
    for r in found:
        inside = sorted(v for k, s, v in rows if k == r.k and r.end - 24 < s // 3600 <= r.end and v is not None and abs(v) < float("inf"))
        assert (r.n, r.least, r.most) == (len(inside), inside[0], inside[-1]) and r.total == pytest.approx(sum(inside))
        for i, share in enumerate(shares):
            below, up_to = sum(v < r[f"q{i}"] for v in inside), sum(v <= r[f"q{i}"] for v in inside)
            slack = 3 * sketches.rank_error(100) + 1 / len(inside)
            assert below / len(inside) - slack <= share <= up_to / len(inside) + slack


def test_few_values_are_kept_as_they_are(spark):
    df = spark.createDataFrame([("a", i % 24 * 3600, float(i)) for i in range(99)], "k string, s long, v double").withColumn("t", F.timestamp_seconds("s"))
    merged = sketches.blocks(sketches.hourly(df, ["k"], "t", "v", k=200), ["k"], 24, k=200)
    ends = spark.createDataFrame([("a", 23)], "k string, end long")
    row = sketches.windows(merged, ["k"], ends, 24, k=200).select(*(sketches.quantile(s).alias(str(s)) for s in (0.0, 0.5, 1.0))).first()
    assert tuple(row) == (0.0, 49.0, 98.0)


def test_wrong_quantiles_are_out_of_bounds(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1000)], "k string, v double")
    found = spark.createDataFrame([("a", 0.5, 500.0), ("a", 0.5, 520.0), ("a", 0.95, 940.0)], "k string, share double, quantile double")
    got = {r.quantile: r.ok for r in sketches.ranks(df, ["k"], "v", found).select("quantile", sketches.within(0.005).alias("ok")).collect()}
    assert got == {500.0: True, 520.0: False, 940.0: False}


@pytest.mark.parametrize("span", [1, 5, 8, 20, 168])
def test_tiles_hold_each_hour_of_a_window_once(spark, span):
    ends = spark.range(-30, 60).select(F.col("id").alias("end"))
    for r in ends.select("end", sketches.tiles(F.col("end"), F.lit(span)).alias("parts")).collect():
        assert sorted(h for p in r.parts for h in range(p.at * p.size, (p.at + 1) * p.size)) == list(range(r.end - span + 1, r.end + 1))


def test_ranks_of_windows_are_those_of_their_values(spark):
    rows, df = made(spark, 3000)
    asked = [(k, e, s, share, q) for k in "abc" for e in (0, 30, 77, 199, 230) for s in (1, 24, 100) for share, q in ((0.1, -3.0), (0.5, 2.0), (0.5, 2.5), (0.9, -0.0))]
    found = spark.createDataFrame(asked, "k string, end long, span int, share double, quantile double")
    got = {(r.k, r.end, r.span, r.share, r.quantile): (r.n, r.below, r.up_to) for r in sketches.window_ranks(df, ["k"], "t", "v", found).collect()}
    assert len(got) == len(asked)
    for k, e, s, share, q in asked:
        inside = [v for key, t, v in rows if key == k and e - s < t // 3600 <= e and v is not None and abs(v) < float("inf")]
        assert got[k, e, s, share, q] == (len(inside), sum(v < q for v in inside), sum(v <= q for v in inside))


def test_neither_values_nor_covers_are_broadcast(spark):
    plan = QUERIES["sketch_window_ranks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


@pytest.mark.parametrize("by_place", [False, True])
def test_records_with_sketches_differ_in_percentiles_alone(spark, by_place):
    df = rated(spark, SF).persist()
    exact, near = (metric_records(df, 24, by_place, 100, 5, (), least=2, sketch_k=k).drop("computed_at", "metrics_json").collect() for k in (None, 400))
    fuzzy = {"distribution_json", *(c for c in exact[0].asDict() if c.endswith("_seconds") and ("median" in c or "p95" in c))}
    known = {r.metric_id: r for r in near}
    assert len(known) == len(exact) > 0
    for r in exact:
        other = known[r.metric_id]
        assert {k: v for k, v in r.asDict().items() if k not in fuzzy} == {k: v for k, v in other.asDict().items() if k not in fuzzy}
        a, b = json.loads(r.distribution_json), json.loads(other.distribution_json)
        assert a.keys() == b.keys()
        for c in a:
            assert (a[c]["count"], a[c]["min"], a[c]["max"]) == (b[c]["count"], b[c]["min"], b[c]["max"]) and a[c]["mean"] == pytest.approx(b[c]["mean"])
            assert all(a[c]["min"] <= b[c][p] <= a[c]["max"] for p in ("p05", "p50", "p95"))
    df.unpersist()
