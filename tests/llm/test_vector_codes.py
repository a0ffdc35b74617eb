"""Metric trees and product codes against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import queries, vector_codes
from tidewright.llm.metric_tree import VantageTree, squared

from ..conftest import SF


def nearest(points, entries):
    away = ((points.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(2)
    which = np.array([min(range(len(entries)), key=lambda e: (row[e], e)) for row in away])
    return which, away[np.arange(len(points)), which].astype(np.int64)


@pytest.mark.parametrize("spread,dims,entries", [(3, 2, 60), (1, 4, 256), (2000, 16, 256), (1 << 27, 16, 40), (5, 1, 9), (0, 3, 30)])
def test_the_tree_finds_the_nearest_entry_and_the_lower_of_equals(spread, dims, entries):
    dice = np.random.default_rng(spread + dims)
    book, points = (dice.integers(-spread, spread + 1, (n, dims)) for n in (entries, 500))
    which, away = VantageTree(book).search(points)
    want, least = nearest(points, book)
    assert (which == want).all() and (away == least).all()


def test_the_tree_leaves_out_what_can_not_be_nearer():
    dice = np.random.default_rng(5)
    centres = dice.integers(-100_000, 100_000, (16, 8))
    book = (centres[:, None, :] + dice.integers(-50, 51, (16, 16, 8))).reshape(-1, 8)
    points = centres[dice.integers(0, 16, 1000)] + dice.integers(-50, 51, (1000, 8))
    tree = VantageTree(book)
    which, away = tree.search(points)
    want, least = nearest(points, book)
    assert (which == want).all() and (away == least).all()
    assert tree.measured < 0.25 * len(points) * len(book)  # brute force measures all


def test_distances_beyond_doubles_are_exact_and_beyond_64_bits_an_error():
    a, b = np.array([[(1 << 29) + 1, 3]]), np.array([[-(1 << 29), 2]])
    assert squared(a, b)[0, 0] == ((1 << 30) + 1) ** 2 + 1
    with pytest.raises(ValueError):
        squared(a << 3, b << 3)


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, lab, [math.floor(scale * float(x)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    dims = len(first[0][2])
    kept, first = [r for r in kept if len(r[2]) == dims], [r for r in first if len(r[2]) == dims]
    points = np.split(np.array([r[2] for r in kept], np.int64), parts, axis=1)
    books = np.split(np.array([r[2] for r in first], np.int64), parts, axis=1)
    for _ in range(rounds):
        for k in range(parts):
            which, _ = nearest(points[k], books[k])
            books[k] = np.array([[math.floor(sum(c) / len(c)) if len(c) else old for c, old in zip(points[k][which == e].T.tolist() or [[]] * len(book), book)] for e, book in enumerate(books[k].tolist())])
    found = [nearest(points[k], books[k]) for k in range(parts)]
    errors = sum(away for _, away in found).tolist()
    by_label = {}
    for (_, lab, _), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    codes = ["".join(f"{w[j]:02x}" for w, _ in found) for j in range(len(kept))]
    return sorted(((i, c, e, by_label[lab]) for (i, lab, _), c, e in zip(kept, codes, errors)), key=str), digest


def coded(spark, rows, **options):
    shaped = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("error", F.lit(1)).repartition(3)
    made = vector_codes.compress(shaped, **options)
    if made is None:
        return [], None
    out = vector_codes.with_label_error(made.rows).select("vec_id", F.lower(F.hex("code")), "error", "label_error")
    return sorted(map(tuple, out.collect()), key=str), made.digest()


def random_rows(n, dims, seed, spread=0.5):
    dice = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in dice.normal(0, spread, dims)], None if i % 5 == 0 else int(i % 3)) for i in range(n)]


def test_codes_equal_brute_force(spark):
    rows = random_rows(90, 8, 1) + [(200 + k, [0.25] * 8, 1) for k in range(40)] + [(7, [0.5, -0.5] * 4, 2)]
    assert coded(spark, rows, entries=16) == brute(rows, entries=16)
    assert coded(spark, rows, entries=256, rounds=2) == brute(rows, entries=256, rounds=2)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [0.0, -inf, 0.0, 0.0], 2), (5, [0.1, -0.1, 0.0, -0.0005], None), (None, [1.0, 2.0, 3.0, 4.0], None), (5, [0.1, -0.1, 0.0, -0.0005], 3), (6, [], 1), (7, [1.0] * 8, 1), (8, [-1.0, 0.5, 0.5, 0.5], 1)]
    assert coded(spark, rows) == brute(rows) and len(brute(rows)[0]) == 4
    assert coded(spark, rows[:4]) == ([], None) and coded(spark, []) == ([], None)
    with pytest.raises(ValueError):
        coded(spark, [(1, [1.0] * 6, 1)])


def test_decoding_gives_the_entries(spark):
    rows = random_rows(30, 8, 2)
    made = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    for r in vector_codes.decode(made.rows, made.books).collect():  # as many entries as vectors
        assert r.error == 0 and r.approximate == [math.floor(1024 * x) / 1024 for x in rows[r.vec_id][1]]


def test_the_query_equals_brute_force_on_a_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, digest = brute(rows)
    out = queries.op12_vector_codes(spark, SF).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out), key=str) == want and {r.codebooks_sha256 for r in out} == {digest}
