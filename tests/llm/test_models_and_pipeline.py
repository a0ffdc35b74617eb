"""Held-out accuracy of the fitted models, odd rows, and the pipeline stage by stage against brute force."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import decontaminate, frames, near_dedup, quality_classifier, quality_rules, toxicity
from tidewright.llm.frames import fold, maybe_in

from ..conftest import SF
from .test_text_operators import binomial_tail, encoder, py_repeat
from .test_words_and_dedup import brute

BAD = ("vile", "rotten", "foul")


def fold_of(i, parts):
    return zlib.crc32(str(i).encode()) % parts


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(8)
    words = ["t%d" % i for i in range(300)]
    rows = []
    for i in range(1500):
        label = int(rng.random() < 0.2)
        text = rng.choices(words, k=rng.randrange(20, 60))
        for _ in range(2 * label):
            text.insert(rng.randrange(len(text)), rng.choice(BAD).upper() + ",")
        rows.append((i, " ".join(text), label))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)


def test_toxicity_on_held_out_rows(spark, toxic):
    held = fold(F.col("doc_id"), 4) == 2
    labels = toxic.select("doc_id", "toxic")
    out = toxicity.score(toxic.withColumn("score", F.lit("clash")), labels, held).join(labels, "doc_id").toPandas()
    assert len(out) == 1500 and (out.held_out == [fold_of(i, 4) == 2 for i in out.doc_id]).all()
    test = out[out.held_out]
    assert ((test.predicted == 1) == (test.toxic == 1)).mean() > 0.97
    assert out.score.between(0, 1).all() and ((out.score >= 0.3).astype(int) == out.predicted).all()
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(toxic, flipped, held).toPandas()
    assert np.allclose(out.sort_values("doc_id").score, again.sort_values("doc_id").score)  # held-out labels are not read


def test_toxicity_of_odd_rows(spark, toxic):
    odd = spark.createDataFrame([(None, "vile"), (1, None), (1, ""), (2, "vile rotten foul " * 2000)], "doc_id long, text string")
    labels = toxic.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 0), (4, 1)], "doc_id long, toxic int"))
    out = toxicity.score(toxic.select("doc_id", "text").unionByName(odd), labels, F.lit(False))
    assert out.count() == 1504 and out.filter("score is null or isnan(score)").count() == 0
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert toxicity.score(odd, some, F.lit(False)).filter("score between 0 and 1").count() == 4
    assert toxicity.score(odd.limit(0), labels, F.lit(False)).count() == 0


def test_toxicity_reads_every_word_of_a_text(spark):
    rows = [(1, "people like you are trash")] * 5 + [(0, "you are kind and the trash is collected for people like you")] * 5 + [(1, "you are a solitary case")]
    model = spark.sparkContext.broadcast(toxicity.fit_models(spark.createDataFrame(rows, "label int, text string")))
    texts = ["you are kind and trash is collected for people like you are trash", "you are trash " * 50 + "kind", "a solitary case", "", None]
    got = toxicity.normalised_ratios(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]).collect()
    want = []
    for text in texts:
        hashes = [next(toxicity._sequences(pa.array([w])))[2][0] for w in (text or "").split()]
        ratios = [float(model.value.ratios(np.array([b]), np.array([w]))[0]) for b, w in zip([toxicity.START, *hashes], hashes)]
        want.append([sum(x) / max(len(x), 1) for x in (ratios, [max(r - toxicity.STRONG, 0) for r in ratios])])
    got = [(r.ratio, r.strong**2) for r in sorted(got, key=lambda r: r.doc_id)]
    assert np.allclose(got, want, atol=1e-5)
    assert got[2][0] > 0  # words met once in training speak too


@pytest.fixture(scope="module")
def sites(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        host = "big" if rng.random() < 0.4 else "h%d" % rng.randrange(30)
        good = int(rng.random() < (0.2 if host in ("h1", "h2") else 0.9))
        plain = " ".join("w%d" % rng.randrange(5000) for _ in range(40))
        rows.append((i, plain if good else plain.replace(" ", " ### ") if rng.random() < 0.8 else plain, host, "p%d" % rng.randrange(3), good))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int").repartition(3)


def test_quality_on_held_out_rows(spark, sites):
    held = fold(F.col("doc_id"), 4) == 2
    labels = sites.select("doc_id", "quality")
    out = quality_classifier.judge(sites.withColumn("kept", F.lit(1)), labels, held_out=held).join(sites.select("doc_id", "quality", "source", "text"), "doc_id").toPandas()
    test = out[out.held_out]
    assert len(out) == 3000 and test[test.quality == 1].kept.mean() > 0.95
    junk = test[test.text.str.contains("###")]
    assert junk.kept.mean() < 0.05
    poor, fair = (out[out.source.isin(x)].host_rate.mean() for x in (["h1", "h2"], ["h5", "h6"]))
    assert poor < fair - 0.2  # sites speak where texts do not
    rate = out.groupby("source").agg(n=("doc_id", "size"), r=("host_rate", "mean"))
    assert abs(rate.r[rate.n < 100] - fair).min() < 0.1


def test_quality_of_odd_rows(spark, sites):
    odd = spark.createDataFrame([(None, "a b", None, None), (1, None, "h1", "x"), (1, "", "new", "new"), (5000, "x " * 20000, "big", None)], "doc_id long, text string, source string, lang string")
    labels = sites.select("doc_id", "quality")
    both = sites.select("doc_id", "text", "source", "lang").unionByName(odd)
    out = quality_classifier.judge(both, labels)
    assert out.count() == 3004 and out.filter("score is null or isnan(score)").count() == 0
    carried = quality_classifier.judge(both, labels, carry=True)
    assert carried.columns == both.columns and carried.count() == out.filter("kept").count()
    assert quality_classifier.judge(odd, labels.limit(0)).count() == 4
    assert quality_classifier.judge(odd.limit(0), labels).count() == 0


def test_keys_too_many_for_a_bitmap_are_joined(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"), "id")
    keys = spark.range(0, 2000, 7).union(spark.range(0, 70, 7))
    joined = maybe_in(df, "k", keys, most_bits=1 << 10)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, df.filter("k % 7 = 0").collect()))
    exact = maybe_in(df, "k", keys, bits=1 << 26).join(keys.distinct().withColumnRenamed("id", "k"), "k")  # what follows a bitmap
    assert sorted(tuple(r) for r in exact.select("k", "id").collect()) == sorted(map(tuple, joined.collect()))


def test_a_task_of_a_large_bitmap_stays_small():
    keys = np.random.default_rng(1).integers(0, 1 << 62, 200_000)
    batches = [pa.record_batch([pa.array(keys[a : a + 10_000])], ["k"]) for a in range(0, len(keys), 10_000)]
    tracemalloc.start()
    rows = sum(b.num_rows for b in frames._places(iter(batches), 1 << 30))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 199_000 and peak < 5 << 20  # all 16,384 pieces are touched
    piece = frames._piece(pa.table({"piece": pa.array([3, 3], pa.int32()), "place": pa.array([0, 65_535], pa.int32())}))
    bits = np.unpackbits(np.frombuffer(piece.column("bits")[0].as_py(), np.uint8))
    assert np.flatnonzero(bits).tolist() == [0, 65_535] and piece.column("piece").to_pylist() == [3]


def test_the_bitmap_loses_no_key(spark):
    df, keys = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 7)
    for bits in (1 << 26, 1 << 16):
        kept = {r.k for r in maybe_in(df, "k", keys, bits).collect()}
        assert set(range(0, 5000, 7)) <= kept
    assert len({r.k for r in maybe_in(df, "k", keys).collect()}) < 800
    assert maybe_in(df, "k", keys.limit(0)).count() == 0


def test_rows_that_may_be_in_go_on_in_the_same_worker(spark):
    df, keys = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("text "), "id").alias("text")), spark.range(0, 1000, 7)

    def lengths(batch):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.utf8_length(batch.column(1)).cast(pa.int64())], ["k", "n"])

    for most in (frames.MOST_BITS, 1 << 10):
        found = maybe_in(df, "k", keys, most_bits=most, then=lengths, schema="k long, n long")
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert {(k, len(f"text {k}")) for k in range(0, 1000, 7)} <= {tuple(r) for r in found.collect()} <= {(k, len(f"text {k}")) for k in range(1000)}


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    functions = dict(corpus_pipeline.STAGES)
    assert list(functions) == ["quality classifier", "quality rules", "near-duplicates", "decontamination", "byte-level BPE"]
    one = functions["quality classifier"](spark, docs, SF).cache()
    rows = [(r.doc_id, r.text, r.source, r.lang, r.quality) for r in docs.join(labels, "doc_id", "left").collect()]
    want = {i for i, (*_, score) in plain_quality(rows).items() if score >= 0.5}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns
    two = functions["quality rules"](spark, one, SF).cache()
    cut = quality_rules.cutoffs(quality_rules.signals(one), labels)
    if cut.isEmpty():  # too few labels here to allow any cutoff: the base alone decides
        assert {r.doc_id for r in two.collect()} == {r.doc_id for r in one.collect() if len(r.text.encode().split()) >= 20 and 100 * py_repeat(r.text) <= 30 * len(r.text.encode().split())}
    three = functions["near-duplicates"](spark, two, SF).cache()
    groups = brute([(r.doc_id, r.text) for r in two.collect()], 80)
    assert {r.doc_id for r in three.collect()} == {i for i, (_, c) in groups.items() if i == c}
    four = functions["decontamination"](spark, three, SF).cache()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in three.collect() if not any(b.rstrip(".").lower() in r.text.lower() for b in items)}
    assert {r.doc_id for r in four.collect()} == clean and four.columns == docs.columns
    five = functions["byte-level BPE"](spark, four, SF).collect()
    assert {r.doc_id: r.token_ids for r in five} == {r.doc_id: encoder().encode_ordinary(r.text) for r in four.collect()}
    whole = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {r.doc_id for r in five}
    assert decontaminate.contaminated(four, decontaminate.questions(spark.read.parquet(f"{SF}/benchmark.parquet"))).count() == 0


def brute_kneser_ney(rows):
    """chance(w, v, class) of (label, words) rows with dictionaries; any word that isn't among them stands for all others."""
    pair = [Counter(), Counter()]
    for label, words in rows:
        for v, w in zip([None, *words], words):
            pair[label][v, w] += 1
    pair.append(pair[0] + pair[1])
    kinds = [Counter(w for _, w in p) for p in pair]
    context = [Counter() for _ in pair]
    for k, p in enumerate(pair):
        for (v, _), c in p.items():
            context[k][v] += c

    def lost(counts):
        n = Counter(counts.values())
        return toxicity.discounts(n[1], n[2], n[3], n[4])

    def less(count, by):
        return count and by[min(count, 3) - 1]

    by_word, by_pair = [lost(x) for x in kinds[:2]], [lost(x) for x in pair]
    vocabulary = sorted(kinds[2])

    def shared(w):
        return (kinds[2][w] + 0.5) / (sum(kinds[2].values()) + 0.5 * (len(kinds[2]) + 1))

    def word(w, k):
        n = sum(kinds[k].values())
        if not n:
            return shared(w)
        return (kinds[k][w] - less(kinds[k][w], by_word[k]) + sum(less(c, by_word[k]) for c in kinds[k].values()) * shared(w)) / n

    def interpolated(w, v, k, lower):
        n = context[k][v]
        left = sum(less(c, by_pair[k]) for (u, _), c in pair[k].items() if u == v)
        c = pair[k][v, w]
        return (c - less(c, by_pair[k]) + left * lower) / n if n else lower

    def adapted(w, v, k):
        return interpolated(w, v, 2, shared(w)) * word(w, k) / shared(w)

    norms = {}

    def chance(w, v, k):
        if (v, k) not in norms:
            norms[v, k] = sum(adapted(x, v, k) for x in [*vocabulary, "a word never met"])
        return interpolated(w, v, k, adapted(w, v, k) / norms[v, k])

    return chance, vocabulary


def test_the_chances_after_any_word_add_up_to_one(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.3), [rng.choice("abcdefghij") if rng.random() < 0.7 else "r%d" % rng.randrange(40) for _ in range(rng.randrange(1, 12))]) for _ in range(60)]
    docs = spark.createDataFrame([(label, " ".join(w)) for label, w in rows], "label int, text string")
    pairs, contexts, words, unmet = (x.collect() if hasattr(x, "collect") else x for x in toxicity.estimates(docs))
    for side, other in zip(toxicity.SIDES, range(2)):
        word = {r.word: r[f"c_{side}"] for r in words}
        assert sum(word.values()) + unmet[other] == pytest.approx(1, abs=1e-9)
        met = {}
        for r in pairs:
            met.setdefault(r.before, {})[r.word] = r[f"c_{side}"]
        for r in contexts:  # words met after it, and all others by their own chances
            others = sum(c for w, c in word.items() if w not in met[r.before]) + unmet[other]
            assert sum(met[r.before].values()) + r[f"c_{side}"] * others == pytest.approx(1, abs=1e-9)
            assert all(0 < c < 1 for c in met[r.before].values())
    chance, vocabulary = brute_kneser_ney(rows)
    for v in (None, "a", "b", "r1", "nowhere"):
        for k in range(2):
            assert sum(chance(w, v, k) for w in [*vocabulary, "a word never met"]) == pytest.approx(1, abs=1e-9)


def test_toxicity_scores_equal_a_plain_model(spark):
    rng = random.Random(17)
    words = ["w%d" % rng.choice([rng.randrange(30), rng.randrange(300)]) for _ in range(400)]
    rows = []
    for i in range(400):
        label = int(rng.random() < 0.3)
        text = rng.choices(words, k=rng.randrange(1, 40)) + ["vile", "w1"] * (label * rng.randrange(3))
        rng.shuffle(text)
        rows.append((i, " ".join(text), label))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = fold(F.col("doc_id"), 4) == 2
    got = {r.doc_id: r.score for r in toxicity.score(docs, docs.select("doc_id", "toxic"), held).collect()}
    fourth = {r.doc_id for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).select("doc_id").collect()}
    train = [r for r in rows if fold_of(r[0], 4) != 2]
    chance, _ = brute_kneser_ney([(label, text.split()) for i, text, label in train if i not in fourth])
    known = {}

    def ratio(v, w):
        if (v, w) not in known:
            known[v, w] = math.log(chance(w, v, 1)) - math.log(chance(w, v, 0))
        return known[v, w]


    def means(text):
        w = text.split()
        ratios = [ratio(*x) for x in zip([None, *w], w)]
        return [sum(ratios) / len(w), math.sqrt(sum(max(r - toxicity.STRONG, 0) for r in ratios) / len(w))]

    scale = [r for r in train if r[0] in fourth]
    weights = toxicity.logistic(np.array([means(text) for _, text, _ in scale]), np.array([float(label) for *_, label in scale]))
    for i, text, _ in rows:
        one, two = means(text)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(weights[0] * one + weights[1] * two + weights[2]))), abs=1e-4), i


def test_words_met_once_move_a_score(spark):
    rows = [(1, "plain words and one unheard slur")] + [(k % 2, f"plain words and more plain words {k % 7}") for k in range(20)]
    model = toxicity.fit_models(spark.createDataFrame(rows, "label int, text string"))
    ratio = lambda text: next(toxicity._sequences(pa.array([text])))
    _, before, hashes, _ = ratio("never slur")
    assert model.ratios(before, hashes)[1] > 0.3
    _, before, hashes, _ = ratio("one unheard")
    assert model.ratios(before, hashes)[1] > 0.3


def test_the_toxicity_sample_is_bounded_in_bytes(spark, toxic):
    labels = toxic.select("doc_id", "toxic")
    out = toxicity.score(toxic, labels, F.lit(False), sample_bytes=1).filter("score between 0 and 1")
    assert out.count() == 1500  # one text of each class is enough to go on


def plain_features(text):
    """The classifier's features in plain Python."""
    raw = (text or "").encode()
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw), raw
    w = raw[0].split()
    if not w:
        return [0.0] * 12
    count = lambda these: sum(chr(b) in these for b in raw[1])
    letters = sum(map(len, w))
    pairs = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)}
    shares = [count(x) / letters for x in ("#*$%&<>^~=_", "|", "!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-")]
    return [math.log1p(len(w)), letters / len(w), len(set(w)) / len(w), len(pairs) / len(w), *shares, math.log1p(letters / (count("\n") + 1)), sum(len(x) <= 3 for x in w) / len(w)]


def plain_quality(rows, held_out=lambda i: False):
    """{id: (host rate, path rate, evidence, score)} of rows (id, text, host, path, label or None)."""
    label = {i: q for i, *_, q in rows if q is not None and not held_out(i)}
    x = np.array([plain_features(t) for _, t, *_ in rows])
    x = np.hstack((x, x * x, np.sqrt(x)))
    chosen = [k for k, (i, *_) in enumerate(rows) if i in label]
    weights = toxicity.logistic(x[chosen], np.array([float(label[rows[k][0]]) for k in chosen]), ridge=1.0)
    rate = (sum(label.values()) + 1) / (len(label) + 2)
    prior = math.log(rate / (1 - rate))
    evidence = np.clip(x @ weights[:-1] + weights[-1] - prior, -30, 30)
    y = [label.get(i, 1 / (1 + math.exp(-(evidence[k] + prior)))) for k, (i, *_) in enumerate(rows)]
    paths, hosts = {}, {}
    for (_, _, h, p, _), v in zip(rows, y):
        paths.setdefault((h, p), []).append(v)
    for (h, _), v in paths.items():
        hosts.setdefault(h, []).extend(v)
    mean = sum(y) / len(y)

    def strength(groups):
        n = sum(len(v) for v, _ in groups)
        spread = sum(len(v) * (sum(v) / len(v) - m) ** 2 for v, m in groups)
        one, weighed = sum(m * (1 - m) for _, m in groups), sum(len(v) * m * (1 - m) for v, m in groups) / n
        return min(max(weighed / max((spread - one) / n, 1e-6) - 1, 1.0), 1e6)

    a = strength([(v, mean) for v in hosts.values()])
    b = strength([(v, (sum(hosts[h]) + a * mean) / (len(hosts[h]) + a)) for (h, _), v in paths.items()])
    out = {}
    for k, (i, _, h, p, _) in enumerate(rows):
        host = (sum(hosts[h]) - y[k] + a * mean) / (len(hosts[h]) - 1 + a)
        path = (sum(paths[h, p]) - y[k] + b * host) / (len(paths[h, p]) - 1 + b)
        out[i] = host, path, evidence[k], 1 / (1 + math.exp(-(evidence[k] + math.log(path / (1 - path)))))
    return out


def test_quality_scores_equal_a_plain_model(spark):
    rng = random.Random(23)
    rows = []
    for i in range(500):
        host, path = "h%d" % (rng.randrange(6) if rng.random() < 0.7 else 0), "p%d" % rng.randrange(3)
        good = int(rng.random() < (0.3 if host == "h2" else 0.85))
        words = ["Word%d" % rng.randrange(300) for _ in range(rng.randrange(0, 50))]
        text = (" " if good or rng.random() < 0.3 else " ## ").join(words) + "!" * rng.randrange(3)
        rows.append((i, text if rng.random() < 0.97 else None, host, path, good if rng.random() < 0.7 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")
    out = {r.doc_id: r for r in quality_classifier.judge(docs, docs.select("doc_id", "quality"), held_out=fold(F.col("doc_id"), 4) == 2).collect()}
    for i, (host, path, evidence, want) in plain_quality(rows, lambda i: fold_of(i, 4) == 2).items():
        assert (out[i].host_rate, out[i].path_rate) == pytest.approx((host, path), abs=1e-6)
        assert out[i].evidence == pytest.approx(evidence, abs=1e-5) and out[i].score == pytest.approx(want, abs=1e-6) and out[i].kept == (out[i].score >= 0.5)
    assert out[next(i for i, r in enumerate(rows) if r[2] == "h2")].host_rate < out[next(i for i, r in enumerate(rows) if r[2] == "h1")].host_rate - 0.2


def test_rows_carried_keep_columns_of_any_name(spark, sites):
    docs = sites.select("doc_id", "text", "source", "lang", *(F.lit(k).alias(name) for k, name in enumerate(("host", "path", "_0", "label", "evidence", "p", "kept", "a.b"))))
    kept = quality_classifier.judge(docs, sites.select("doc_id", "quality"), carry=True)
    assert kept.columns == docs.columns
    assert kept.select("host", "path", "_0", "label", "evidence", "p", "kept", "`a.b`").distinct().collect() == [tuple(range(8))]
    clean = decontaminate.clean(docs, spark.createDataFrame([(1, "nothing like it here at all", None)], "item_id long, question string, answer string"))
    assert clean.columns == docs.columns and clean.count() == 3000


A, B = "one two three four five six seven eight nine ten", "a b c d e f g h i j k l m n o p"


def test_one_row_of_repeated_documents_stays(spark):
    rows = [(1, A, "x"), (1, A, "w"), (2, A, "v"), (None, A, "u"), (None, A, "u"), (3, B, "t"), (3, B, "t"), (3, "other words " * 9, "s"), (None, None, "r"), (None, None, "q"), (None, "", "p"), (4, None, "o"), (4, None, "n"), (None, "only nameless here " * 4, "m"), (None, "only nameless here " * 4, "l"), (5, "lone", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("a.b", F.lit(1)).withColumn("row", F.lit(2)).repartition(3)
    kept = near_dedup.keep_one(docs, percent=80, bands=40)
    assert kept.columns == docs.columns
    want = [(1, A, "w"), (3, B, "t"), (3, "other words " * 9, "s"), (None, None, "q"), (None, "", "p"), (4, None, "n"), (None, "only nameless here " * 4, "l"), (5, "lone", "k")]
    assert sorted(map(str, ((r.doc_id, r.text, r.key) for r in kept.collect()))) == sorted(map(str, want))
    assert near_dedup.keep_one(docs.limit(0)).count() == 0
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, SF)
    assert sorted(r.key for r in stage.collect()) == sorted(r[2] for r in want)


def test_rules_with_cutoffs_in_force(spark, tmp_path):
    rng = random.Random(31)
    rows, grades = [], []
    for i in range(9000):
        lang, good = rng.choice(["en", "de"]), rng.random() < 0.7
        words = ["word%d" % rng.randrange(400) for _ in range(rng.randrange(15, 40))]
        if not good and rng.random() < 0.8:
            words = [w + "##$" if lang == "en" else w.upper() for w in words]
        rows.append((i, " ".join(words), lang, "s", 1))
        if i % 5 < 4:
            grades.append((i, int(good)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(grades, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality rules"](spark, docs, str(tmp_path)).collect()}

    def shares(text):
        solid = "".join(text.split())
        lines = [x for x in text.split("\n") if x.split()]
        return {"symbol_share": sum(c in quality_rules.SYMBOLS for c in text) / len(solid), "upper_share": sum(c.isupper() for c in text) / len(solid), "dup_line_share": 1 - len(set(lines)) / len(lines), "repeat_share": py_repeat(text) / len(text.split())}

    base = {i: len(t.split()) >= 20 and 100 * py_repeat(t) <= 30 * len(t.split()) for i, t, *_ in rows}
    measured, lang_of, chosen = {i: shares(t) for i, t, *_ in rows}, {r[0]: r[2] for r in rows}, {}
    tests = sum(map(len, quality_rules.GRID.values())) * 2
    for lang in ("en", "de"):
        held = [(measured[i], g) for i, g in grades if base[i] and lang_of[i] == lang]
        n, m = sum(g == 1 for _, g in held), sum(g != 1 for _, g in held)
        for rule, cutoffs in quality_rules.GRID.items():
            for c in cutoffs:
                k, caught = (sum(x[rule] > c for x, g in held if (g == 1) == side) for side in (True, False))
                rate = 0.02 / len(quality_rules.GRID)
                tail = binomial_tail(n, k, rate) if k < n * rate else 1.0
                gain = caught / max(m, 1) - k / max(n, 1)
                if tail * tests <= 0.05 and gain > 0:
                    chosen[lang, rule] = max(chosen.get((lang, rule), (0, 0)), (gain, c))
    assert ("en", "symbol_share") in chosen and ("de", "upper_share") in chosen
    fires = lambda i: any(measured[i][rule] > c for (lang, rule), (_, c) in chosen.items() if lang == lang_of[i])
    assert kept == {i for i in base if base[i] and not fires(i)} and len(kept) < sum(base.values()) - 200
