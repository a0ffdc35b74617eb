"""Line dedup: filters, the store under insertions and removals, and results against brute force."""

import hashlib
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import line_dedup, queries
from tidewright.llm.cuckoo import Cuckoo
from tidewright.llm.frames import checkpoint_dir, looked_up
from tidewright.llm.line_dedup import LineStore

from ..conftest import SF

SPACE = " \t\n\x0b\x0c\r"


def random_keys(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 64, (n, 2), np.uint64)


def test_a_filter_holds_what_was_added_and_forgets_what_was_removed():
    keys, others = random_keys(50_000, 1), random_keys(50_000, 2)
    held = Cuckoo.build(keys)
    assert held.has(keys).all() and held.has(others).mean() < 0.001 and len(held) == len(keys)
    held.remove(keys[:30_000])
    assert held.has(keys[30_000:]).all() and held.has(keys[:30_000]).mean() < 0.001 and len(held) == 20_000
    assert held.room_for(20_000) and held.add(others[:20_000])
    assert held.has(np.concatenate([keys[30_000:], others[:20_000]])).all()
    assert Cuckoo.load(held.dump()).has(keys[30_000:]).all()
    with pytest.raises(KeyError):
        held.remove(random_keys(100, 3))


def test_keys_of_one_fingerprint_have_a_slot_each():
    keys = random_keys(6, 4)
    keys[:, 1] = keys[0, 1]  # all in the same two buckets
    held = Cuckoo.of_size(1000)
    assert held.add(keys) and len(held) == 6
    held.remove(keys[:5])
    assert len(held) == 1 and held.has(keys).all()
    assert not Cuckoo.of_size(1000).add(np.repeat(keys[:1], 9, axis=0))  # nine for eight slots: no place


def key(line, least=10):
    line = line.strip(SPACE)
    line = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return line if len(line) >= least else None


def brute(docs, alive=None):
    """docs: (id, text) rows; alive: ids that count (all)."""
    holders = {}
    for i, t in docs:
        if i is not None and (alive is None or i in alive):
            for x in (t or "").split("\n"):
                if key(x) is not None:
                    holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        counts = i is not None and (alive is None or i in alive)
        stay = [x for x in lines if not (counts and key(x) is not None and len(holders[key(x)]) > 1 and min(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


ODD = [
    (5, "A line of words\nshort\n a line OF words\t\nlast"), (2, "a LINE of words\r\nown line of two"), (9, None), (10, ""), (11, "\n\n"), (None, "a line of words\nnull id"),
    (12, "ÄÖÜ line é\nÄÖÜ line é\n" + "漢字漢字漢字漢字漢字"), (13, "äöü line é\nÄÖÜ line É"), (14, "漢字漢字漢字漢字漢字\n漢字漢字漢字漢字漢"), (15, "漢字漢字漢字漢字漢"), (16, "x" * 300_000 + "\nA line of words\n" * 3),
    (17, "x" * 300_000), (2, "own line of two\nanother row of two"), (18, "another row of two"), (-3, "own line of two"), (19, "123456789\n123456789"), (20, "123456789"), (21, "Ⅷ a line of words"),
]


@pytest.fixture
def folder(spark):
    return f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, key string, n_docs int").repartition(3)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=str)


def test_odd_input_equals_brute_force(spark, folder):
    assert got(line_dedup.deduplicate(frame(spark, ODD), folder)) == brute(ODD)


def test_an_empty_table_has_no_rows(spark, folder):
    empty = frame(spark, ODD).limit(0)
    store = LineStore(spark, folder)
    store.insert(empty)
    assert store.kept(empty).count() == 0
    store.insert(frame(spark, ODD))  # grows from nothing
    assert got(store.kept(frame(spark, ODD))) == brute(ODD)


def made(seed, n=60):
    dice = random.Random(seed)
    lines = [f"line number {k} of some" for k in range(40)] + ["a line that a third has", "tiny"]
    return [(i, "\n".join(dice.choices(lines, k=dice.randint(1, 6)) + (["A line that a third has "] if i % 3 == 0 else []))) for i in range(n)]


def state(store):
    refs = {bytes(r.key): (r.n_docs, r.first_doc) for r in store.refs().collect()}
    held = {r.shard: Cuckoo.load(r.payload) for r in store.filters().collect()}
    return refs, sum(map(len, held.values()))


def test_changes_are_reversible_and_the_store_is_that_of_its_documents(spark, folder):
    docs = made(7)
    store = LineStore(spark, f"{folder}/a")
    store.insert(frame(spark, docs[:30]))
    first = state(store)
    store.insert(frame(spark, docs[20:]))  # ten are there already
    assert got(store.kept(frame(spark, docs))) == brute(docs)
    whole = state(store)
    gone = spark.createDataFrame([(i,) for i in [*range(30, 60), 1000, None]], "doc_id long")
    store.delete(gone)
    assert state(store) == first
    alive = set(range(30))
    assert got(store.kept(frame(spark, docs))) == brute(docs, alive)
    store = LineStore(spark, f"{folder}/a")  # as another session finds it
    store.insert(frame(spark, docs[30:]))
    assert state(store) == whole
    store.delete(spark.createDataFrame([(0,), (3,)], "doc_id long"))
    assert got(store.kept(frame(spark, docs))) == brute(docs, set(range(60)) - {0, 3})
    refs, held = state(store)
    count = Counter(k for i, t in docs if i not in (0, 3) for k in {key(x) for x in t.split("\n")} - {None})
    assert sorted(count.values()) == sorted(n for n, _ in refs.values()) and held == sum(n > 1 for n in count.values())
    assert refs[hashlib.blake2b(b"a line that a third has", digest_size=16).digest()][0] == count["a line that a third has"]


def test_a_full_filter_is_built_anew_from_the_counts(spark, folder):
    docs = [(i, "\n".join(f"common line number {k}" for k in range(i * 0, 2 if i < 2 else 900))) for i in range(4)]
    store = LineStore(spark, folder)
    store.shards = 2
    store.insert(frame(spark, docs[:2]))
    store.insert(frame(spark, docs[2:]))
    assert state(store)[1] == 900 and got(store.kept(frame(spark, docs))) == brute(docs)


def test_filters_too_large_to_broadcast_give_the_same_rows(spark, folder):
    docs = made(8)
    store = LineStore(spark, folder, filter_bytes=1)
    store.insert(frame(spark, docs))
    assert got(store.kept(frame(spark, docs))) == brute(docs)


def test_lookups_of_frequent_keys_equal_a_plain_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter("k <> '7'")
    for most, least in ((20_000, 1000), (2, 10), (1, 10**9)):
        for how in ("inner", "left"):
            mine = looked_up(rows, "k", facts, "n", "id", how, most, least).select("k", "id", "n", "low")
            assert sorted(map(str, mine.collect())) == sorted(map(str, rows.join(facts, "k", how).select("k", "id", "n", "low").collect()))


def test_the_query_equals_brute_force_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(docs))
    assert sorted(map(tuple, queries.op11_line_dedup(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == want
