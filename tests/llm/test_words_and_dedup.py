"""Words, shingles and near-duplicate groups against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import bytewords, near_dedup

SPACES = b" \t\n\x0b\f\r"


def py_words(text):
    return (text or "").encode().lower().split() if text else []


def shingle_set(text):
    w = py_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 0))} or ({tuple(w)} if w else set())


def brute(rows, percent=85):
    """Smallest reachable id of each document, over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


TEXTS = ["", " \n", "A", "a b", "Ünï cödé", "x" * 1000, "one two  three\tfour\nfive six", "word " * 400, "\x0bq\x0c", "end\r", "a b"]


def test_words_are_those_of_the_pattern():
    column = pa.array([*TEXTS, None])
    for row, end, data, offsets in bytewords.text_slices(column, 64):
        words = bytewords.words(data, offsets)
        found = words.strings()
        for k in range(end - row):
            assert found[words.first[k] : words.first[k + 1]] == py_words(column[row + k].as_py())


def test_hashes_tell_words_apart():
    vocabulary = sorted({bytes(random.Random(i).choices(b"abcxyz", k=i % 40 + 1)) for i in range(3000)} | {b"y" * n for n in (255, 256, 257, 900)})
    data, ends = np.frombuffer(b"".join(vocabulary), np.uint8), np.cumsum([len(x) for x in vocabulary])
    hashes = bytewords.hash_spans(data, np.concatenate(([0], ends[:-1])), ends)
    assert len(set(hashes.tolist())) == len(vocabulary)
    again = bytewords.hash_spans(np.concatenate(([7], data)).astype(np.uint8), np.concatenate(([0], ends[:-1])) + 1, ends + 1)
    assert (hashes == again).all()


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.concatenate((a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64)))
    s = near_dedup.circulant_signature(np.concatenate((a, b)), np.array([0, 4000, 8000]), 512)
    assert abs((s[0] == s[1]).mean() - 3000 / 5000) < 0.08


def test_part_sums_never_rule_a_link_out():
    rng = np.random.default_rng(3)
    for n in (5, 40, 300, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for changed in range(0, n, max(1, n // 20)):
            b = np.concatenate((a[changed:], rng.integers(0, 2**63, changed).astype(np.uint64)))
            shared, union = n - changed, n + changed
            one, two = (np.frombuffer(near_dedup.part_sums(x), np.uint8) for x in (a, b))
            possible = near_dedup.may_link(one, two[None, :], np.array([2 * n]), 85)[0]
            assert possible or 100 * shared < 85 * union


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["w%d" % i for i in range(3000)]
    base = [rng.choices(words, k=n) for n in (300, 120, 60, 12, 5, 3)]
    rows, n = [], 100
    for text in base:
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, "  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
            n += 1
    rows += [(n + i, t) for i, t in enumerate(TEXTS)] + [(n + 50, None), (n + 51, rows[0][1]), (3, rows[0][1])]
    rows += [(n + 100 + i, " ".join(rng.choices(words, k=80))) for i in range(60)]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    return near_dedup.near_duplicates(df.repartition(3), **options).collect()


def test_groups_equal_brute_force(spark, corpus):
    want = brute(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, corpus)} == want
    assert {r.doc_id for r in run(spark, corpus) if r.kept} == {i for i, (_, c) in want.items() if i == c}


def test_pairs_between_80_and_85_link_at_80_alone(spark):
    rng = random.Random(41)
    rows = []
    for i in range(40):  # 204 shingles each; two words changed far apart leave 194 of 214 or so, more leave less
        text = rng.choices(["z%d" % k for k in range(5000)], k=204)
        copy = list(text)
        for k in range(4 + i % 2):
            copy[10 + 35 * k] = "changed%d" % rng.randrange(10**9)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    for percent, bands in ((80, 40), (85, 26)):
        want = {i: c for i, (_, c) in brute(rows, percent).items()}
        assert {r.doc_id: r.component_id for r in run(spark, rows, percent=percent, bands=bands)} == want
    assert brute(rows, 80) != brute(rows, 85)


def test_crowded_buckets_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["b%d" % i for i in range(150)]
    rows = []
    for i in range(90):  # copies of one text that mostly link through others
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(150)] = "c%d" % rng.randrange(10**6)
        rows.append((i, " ".join(copy)))
    want = {i: c for i, (_, c) in brute(rows).items()}
    assert {r.doc_id: r.component_id for r in run(spark, rows, small_bucket=2)} == want
    assert {r.doc_id: r.component_id for r in run(spark, rows)} == want


def test_odd_rows_have_defined_results(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (4, ""), (5, None)]
    out = sorted(run(spark, rows), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.component_id, r.kept) for r in out] == [(1, 1, True), (1, 1, True), (2, 1, False), (4, 4, True), (5, 5, True), (None, None, True)]
    assert run(spark, []) == []
    clash = spark.createDataFrame([(1, "a b", 9, True)], "doc_id long, text string, component_id long, kept boolean")
    assert near_dedup.near_duplicates(clash).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    labels = {r.node: r.label for r in near_dedup.components(links).collect()}
    assert set(labels.values()) == {0, 1000} and labels[200] == 0 and labels[1001] == 1000


def test_ids_that_repeat_with_other_texts_link_through_each(spark):
    rng = random.Random(21)
    words = ["v%d" % i for i in range(900)]
    one, two, three = (rng.choices(words, k=120) for _ in range(3))
    near = lambda text, at: " ".join([*text[:at], "changed", *text[at + 1 :]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one, 40)), (3, near(two, 70)), (4, near(three, 9)), (5, " ".join(three)), (6, " ".join(two)), (5, " ".join(three))]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.component_id, r.kept) for r in run(spark, order))
        assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (5, 4, False), (6, 1, False)]


def test_a_hot_bucket_with_one_stranger_stays_linear(spark):
    """One component of 3,000 members and one of another label: blocks of the component don't meet each other."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    nodes = [int(i).to_bytes(16, "big") for i in range(3001)]
    parts = near_dedup.part_sums(base)
    rows = [(7, n, 200, 3001, nodes[0] if i < 3000 else n) for i, n in enumerate(nodes)]
    members = spark.createDataFrame(rows, "key long, id binary, n long, size long, label binary")
    sets = spark.createDataFrame([(n, b"", parts) for n in nodes], "node binary, shingles binary, parts binary")
    met = near_dedup.crowded(members, sets, 85, block=50)
    pairs = {(bytes(r.a), bytes(r.b)) for r in met.collect()}
    assert pairs == {(n, nodes[3000]) for n in nodes[:3000]}
    groups = near_dedup.dealt_blocks(members, sets, 50)
    assert groups.select("key", "one", "two").distinct().count() == 61  # 60 blocks against the stranger's, and that alone
    assert groups.count() == 3000 + 61
