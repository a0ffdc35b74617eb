"""Order statistics and running values by ranges: ties, null groups, hot values, few rows."""

import math

import pytest
from pyspark.sql import functions as F

from tidewright.operators import joins, metrics

ROWS = [("a", float(v)) for v in [5, 5, 5, 5, 5, 5, 1, 9, 2, 7]] + [(None, 4.0), (None, 2.0), ("b", 3.0), ("c", None)]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_ranks_equal_sorting(spark, ranges):
    df = spark.createDataFrame(ROWS, "g string, v double")
    found = metrics.at_ranks(df, "v", lambda n: [n - 1, F.lit(0), F.floor((n - 1) / 2)], ["g"], ranges).collect()
    groups = {g: sorted(v for h, v in ROWS if h == g and v is not None) for g in ("a", "b", None)}
    assert {r.g: (r.n, r["values"]) for r in found} == {g: (len(x), [x[-1], x[0], x[(len(x) - 1) // 2]]) for g, x in groups.items()}


def test_percentiles_interpolate_and_nothing_gives_no_row(spark):
    df = spark.createDataFrame(ROWS, "g string, v double")
    ours = {r.g: r.percentiles for r in metrics.percentiles(df, "v", [0.1, 0.5, 0.99], ["g"]).collect()}
    theirs = {r.g: r.p for r in df.filter("v is not null").groupBy("g").agg(F.percentile("v", [0.1, 0.5, 0.99]).alias("p")).collect()}
    assert ours.keys() == theirs.keys() and all(math.isclose(a, b) for g in ours for a, b in zip(ours[g], theirs[g]))
    assert metrics.percentiles(df.filter("v > 99"), "v", [0.5]).count() == metrics.nearest_rank(df.filter("v > 99"), "v", 0.5).count() == 0


@pytest.mark.parametrize("ranges", [1, 4, 300])
def test_running_maximum_in_any_number_of_ranges(spark, ranges):
    values = [(i, (i * 37) % 101) for i in range(120)]
    out = joins.running_max_before(spark.createDataFrame(values, "i long, v long"), "i", "v", "top", ranges).collect()
    assert {r.i: r.top for r in out} == {i: max((v for j, v in values if j < i), default=None) for i, _ in values}
