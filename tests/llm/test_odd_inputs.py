"""Odd rows of operators whose other tests are over tables: nulls, repeats, clashing names, very long texts, empty tables."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat, decontaminate, quality_classifier, quality_rules, token_counts, toxicity

from .test_models_and_pipeline import sites  # noqa: F401  a fixture
from .test_text_operators import encoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_token_counts_of_odd_rows(spark):
    long = "word and another " * 40_000
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, None), (2, "", "x"), (3, long, None), (4, "é漢😀", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("length", F.lit(7)).withColumn("group", F.lit("clash"))
    counts = token_counts.token_counts(docs, vocabulary=RANKS, pattern=public_tokenizers.PATTERN)
    size = lambda t: len(encoder().encode_ordinary(t))
    got = {(r.group, r.context_limit): (r.n_docs, r.total_docs, r.total_tokens) for r in counts.collect()}
    small, large, odd = size("a b c"), size(long), size("é漢😀")
    assert got == {("x", small): (2, 3, 2 * small), ("x", 0): (1, 3, 2 * small), ("", 0): (1, 2, large), ("", large): (1, 2, large), ("y", odd): (1, 1, odd)}
    assert token_counts.token_counts(docs.limit(0), vocabulary=RANKS, pattern=public_tokenizers.PATTERN).count() == 0


def test_a_very_long_conversation_is_read_back(spark):
    turns = [(1, i, "user" if i // 3 % 2 else "assistant", f"{i} % </s> [INST] <|im_end|>\n" * 3) for i in range(4000)]
    made = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4))
    row = made.select(chat.read_back(F.col("formatted")).alias("turns"), chat.learned(F.col("segments")).alias("learned")).first()
    assert [(t.role, t.text) for t in row.turns] == [(r, t) for *_, r, t in turns]
    assert row.learned == "".join(t for *_, r, t in turns if r == "assistant")


def test_quality_rules_of_odd_rows(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(None, good, "en"), (None, good, "en"), (1, good, None), (1, "other " * 30, "en"), (2, None, "en"), (3, "", None), (4, "x" * 200_000 + " " + good, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("kept", "row", "stratum", "n_words", "base_failed", "rule", "cutoff", "quality", "a.b"):
        docs = docs.withColumn(name, F.lit(name))
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (9, 0)], "doc_id long, quality int")
    judged = sorted(((str(r.doc_id), r.n_words, r.kept) for r in quality_rules.judge(docs, labels).collect()))
    assert judged == sorted([("None", 30, True), ("None", 30, True), ("1", 30, True), ("1", 30, False), ("2", 0, False), ("3", 0, False), ("4", 31, True)])
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4 and kept.select("kept", "`a.b`").distinct().collect() == [("kept", "a.b")]
    assert quality_rules.keep(docs.limit(0), labels).count() == 0


def test_decontamination_keeps_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the river bank today", "s"), (None, None, "t"), (2, "nothing to see", "u"), (2, "nothing to see", "u")], "doc_id long, text string, item_id string")
    docs = docs.withColumn("score", F.lit(1)).withColumn("question", F.lit("q")).withColumn("a.b", F.lit(2))
    items = spark.createDataFrame([(7, "the quick brown fox jumps over the lazy dog near the river bank", None)], "item_id long, question string, answer string")
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["2", "2", "None"]
    assert decontaminate.clean(docs, items.limit(0)).count() == 4 and decontaminate.clean(docs.limit(0), items).count() == 0


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_sites_add_to_the_evidence_where_they_differ(spark, sites):  # noqa: F811
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    plain = sites.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "###", "")).otherwise(F.col("text")))  # a third says nothing by itself
    out = quality_classifier.judge(plain, sites.select("doc_id", "quality"), held_out=held).join(sites.select("doc_id", "quality"), "doc_id").filter("held_out").toPandas()
    assert area(out.score.values, out.quality.values) > area(out.evidence.values, out.quality.values) + 0.01


def test_the_toxicity_model_is_bounded_by_its_sample(spark):
    words = [f"w{i % 997} x{i % 31}" for i in range(3000)]
    docs = spark.createDataFrame([(i, w * 5, i % 2) for i, w in enumerate(words)], "doc_id long, text string, toxic int")

    def size(n):
        held = []
        fit = toxicity.fit_models

        def seen(sample):
            held.append(fit(sample))
            return held[-1]

        toxicity.fit_models = seen
        try:
            toxicity.score(docs.filter(F.col("doc_id") < n), docs.select("doc_id", "toxic"), F.lit(False), sample_bytes=4000)
        finally:
            toxicity.fit_models = fit
        return sum(x.nbytes for x in (held[0].pairs, held[0].pair_ratios, held[0].words, held[0].contexts))

    one, three = size(1000), size(3000)
    assert three == pytest.approx(one, rel=0.35) and three < 2 * 4000 * 12  # 12 bytes a pair, fewer pairs than bytes
