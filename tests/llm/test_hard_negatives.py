"""Hard negatives against brute force, and what the approximation file lets a scan leave out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import hard_negatives, queries
from tidewright.llm.hard_negatives import NEVER, Anchor, Cells, Scan, bound

from ..conftest import SF


def brute(rows, every=100, scale=256, low=80, high=100, k=5):
    kept = [(i, lab, [math.floor(scale * float(x)) for x in v]) for i, v, lab in rows if None not in (i, lab, v) and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in kept:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept if len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2] == lab and s[1] != i)[:k]:
            inside = sorted(s for s in scored if s[2] != lab and -low * p <= -100 * s[0] <= -high * p)
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(inside[:k], 1)]
    return sorted(out)


def mined(spark, rows, every=100, **options):
    shaped = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash")).withColumn("rank", F.lit(1)).repartition(3)
    made = hard_negatives.approximation_file(shaped)
    if made is None:
        return []
    return sorted(map(tuple, hard_negatives.mine(*made, made[0].filter(F.col("vec_id") % every == 0), **options).collect()))


def random_rows(n, dims, seed, labels=3, spread=0.3):
    dice = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in dice.normal(0, spread, dims)], int(dice.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 2, 7, 16])
def test_bounds_hold_the_score(dims):
    dice = np.random.default_rng(dims)
    v = dice.integers(-300, 300, (3000, dims))
    borders = np.stack([np.quantile(v[:50, d], np.arange(1, 32) / 32).astype(np.int64) for d in range(dims)])
    cells = Cells(borders, v.min(0), v.max(0))
    codes = np.ascontiguousarray(cells.codes(v).T).astype(np.intp)
    for anchor in (v[0], -v[1], np.zeros(dims, np.int64)):
        low, high = cells.prices(anchor)
        assert (bound(low, codes) <= v @ anchor).all() and (bound(high, codes) >= v @ anchor).all()
        assert (bound(low, codes[:, :100]) == bound(low, codes)[:100]).all()  # few rows and many rows alike


def test_most_rows_are_never_scored():
    dice = np.random.default_rng(3)
    v = np.floor(dice.normal(0, 32, (20_000, 64))).astype(np.int64)
    borders = np.stack([np.quantile(v[:5000, d], np.arange(1, 32) / 32).astype(np.int64) for d in range(64)])
    cells = Cells(borders, v.min(0), v.max(0))
    ids, labels, codes = np.arange(20_000), np.arange(20_000) % 2, np.ascontiguousarray(cells.codes(v).T).astype(np.intp)
    scan = Scan(cells, Anchor(0, 0, v[0], [(-NEVER, NEVER)]), 5, True)
    for a in range(0, 20_000, 5000):
        scan.see(ids[a : a + 5000], labels[a : a + 5000], v[a : a + 5000], codes[:, a : a + 5000])
    scores = v @ v[0]
    mine = np.flatnonzero((labels == 0) & (ids != 0))
    assert scan.windows[0][2].ids.tolist() == mine[np.lexsort((mine, -scores[mine]))][:5].tolist()
    assert scan.scored < 500  # of 9,999 rows of the label


def test_negatives_equal_brute_force(spark):
    rows = random_rows(300, 6, 1)
    assert mined(spark, rows, 10) == brute(rows, 10) and len(brute(rows, 10)) > 100


def test_ties_repeated_rows_and_a_frequent_vector(spark):
    dice = np.random.default_rng(2)
    rows = [(i, [float(x) / 256 for x in dice.integers(-2, 3, 4)], int(dice.integers(0, 2))) for i in range(200)]
    rows += [(300 + i, [2 / 256, 1 / 256, 0.0, 0.0], i % 3) for i in range(100)] + rows[:20] + [rows[100]] * 2
    assert mined(spark, rows, 20) == brute(rows, 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(60, 4, 4) + random_rows(60, 3, 5) + [(0, None, 1), (100, [nan] * 4, 1), (200, [1.0, None, 1.0, 1.0], 1), (300, [inf] * 4, 1), (400, [1.0] * 4, None), (None, [1.0] * 4, 1), (500, [], 1), (600, [0.0] * 4, 1), (700, [9.0], 1), (800, [-3.0, 2.5, 4.0, 100.0], 2)]
    assert mined(spark, rows, 20) == brute(rows, 20)
    assert mined(spark, rows[120:125]) == [] and mined(spark, []) == []
    assert mined(spark, random_rows(50, 4, 6, labels=1), 10) == []  # no other label
    with pytest.raises(ValueError):
        mined(spark, [(100, [1e9, 1.0], 1)])


def test_blocks_of_anchors_give_the_same_rows(spark):
    rows = random_rows(200, 5, 7)
    assert mined(spark, rows, 10, block_bytes=300) == mined(spark, rows, 10) == brute(rows, 10)


def test_the_query_equals_brute_force_on_a_table(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = queries.op13_hard_negatives(spark, SF)
    assert sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute(rows)
