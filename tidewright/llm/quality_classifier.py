"""Document quality by hierarchical empirical Bayes.

A logistic classifier on shape features gives each text its evidence, a log likelihood ratio.  Sites say what to expect
before reading: a labelled text counts for its site as its label says, any other by the classifier's probability.  The
rate of good texts of a host is shrunk toward the global rate, that of a path toward its host's, each by a strength that
empirical Bayes (the spread between groups beyond chance) estimates from grouped sums over all documents.  A text's
posterior log odds are its path's prior odds, itself left out, plus its evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords
from .frames import cut, over_texts, small_side, written
from .near_dedup import distinct_per_document
from .toxicity import logistic

FEATURES = ("log_words", "word_length", "distinct_share", "distinct_pair_share", "symbol_share", "bar_share", "bang_share", "upper_share", "digit_share", "punctuation_share", "line_length", "common_word_share")


def _masks() -> np.ndarray:
    """Rows by feature: bytes that count for it."""
    rows = ["#*$%&<>^~=_", "|", "!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "\n"]
    return np.array([[chr(b) in row for b in range(256)] for row in rows])


def features(column: pa.Array) -> np.ndarray:
    """(texts, FEATURES) of whole texts; a text without words has zeros."""
    masks, out = _masks(), np.zeros((len(column), len(FEATURES)))
    for row, end, data, offsets in bytewords.text_slices(column, 1 << 20):
        n = end - row
        classes = np.zeros((len(masks), n))
        for k, mask in enumerate(masks):
            classes[k] = np.diff(np.concatenate(([0], np.cumsum(mask[data], dtype=np.int64)))[offsets])
        words = bytewords.words(data, offsets)
        counts, hashes = np.diff(words.first), words.hashes()
        letters = np.diff(np.concatenate(([0], np.cumsum(words.ends - words.starts)))[words.first])
        some, solid = np.maximum(counts, 1), np.maximum(letters, 1)
        distinct = np.diff(distinct_per_document(hashes, words.first)[1])
        pairs, begin = bytewords.shingle_hashes(hashes, words.first, 2)
        two = np.diff(distinct_per_document(pairs, begin)[1])
        short = np.diff(np.concatenate(([0], np.cumsum(words.ends - words.starts <= 3)))[words.first])
        block = [np.log1p(counts), letters / some, distinct / some, two / some, *(c / solid for c in classes[:6]), np.log1p(letters / (classes[6] + 1)), short / some]
        out[row:end] = np.where(counts[:, None] > 0, np.stack(block, axis=1), 0.0)
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and their roots, so that a linear fit can bend."""
    return np.hstack((x, x * x, np.sqrt(np.maximum(x, 0))))


def evidence(docs: DataFrame, weights: np.ndarray, text: str, keep: bool) -> DataFrame:
    """``docs`` with the column evidence after its columns, without the text unless ``keep``."""
    at = docs.columns.index(text)
    others = [i for i in range(len(docs.columns)) if keep or i != at]
    names = [*(docs.columns[i] for i in others), "evidence"]
    schema = T.StructType([*(docs.schema[i] for i in others), T.StructField("evidence", T.DoubleType())])

    def run(batches):
        for batch in batches:
            value = np.clip(expand(features(batch.column(at))) @ weights[:-1] + weights[-1], -30, 30)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), pa.array(value)], names)

    return over_texts(docs, run, schema)


def fit(docs: DataFrame, known: DataFrame, sample: int) -> tuple[np.ndarray, float]:
    """Weights of the evidence and the rate of good texts among the ``sample`` labelled ids that hash lowest."""
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(sample)
    texts = docs.join(F.broadcast(chosen), "doc_id").select("label", "text")  # at most ``sample`` ids

    def run(batches):
        for batch in batches:
            found = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES)), pa.array(found.ravel()))], ["label", "features"])

    rows = over_texts(texts, run, "label int, features array<double>").toArrow().sort_by("label")
    labels = rows.column("label").to_numpy().astype(float)
    values = np.array(rows.column("features").to_pylist() or np.zeros((0, len(FEATURES)))).reshape(-1, len(FEATURES))
    weights = logistic(expand(values), labels, ridge=1.0)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    weights[-1] -= np.log(rate / (1 - rate))
    return weights, float(rate)


def strength(groups: DataFrame, expected: Column) -> float:
    """Prior weight (in texts) toward ``expected``, by moments: between-group variance beyond that of chance.

    ``groups`` has n and good; sums over all groups make one row.
    """
    rate, chance = F.col("good") / F.col("n"), expected * (1 - expected)
    row = groups.select((F.col("n") * (rate - expected) * (rate - expected)).alias("spread"), chance.alias("chance"), "n").agg(F.sum("spread").alias("spread"), F.sum("chance").alias("chance"), F.sum(F.col("n") * F.col("chance")).alias("weighed"), F.sum("n").alias("n")).first()
    if not row.n:
        return 1.0
    mean_chance = max(row.weighed / row.n, 1e-9)
    between = max((row.spread - row.chance) / row.n, 1e-6)  # E[n (r - m)^2] = chance + n * between
    return float(min(max(mean_chance / between - 1, 1.0), 1e6))


def group_column(what: str | Column, name: str) -> Column:
    return F.coalesce((F.col(what) if isinstance(what, str) else what).cast("string"), F.lit("")).alias(name)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", path: str | Column = "lang", held_out: Column | None = None,
          sample: int = 20_000, threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """doc_id, held_out, evidence, host_rate, path_rate, score (probability of good) and kept, one row per input row.

    A path lies within its host; null hosts and paths are groups of their own.  ``labels`` has doc_id and quality;
    labels of rows for which ``held_out`` is true, and null labels, are not read; of repeated labels the best counts.
    The classifier is fitted on at most ``sample`` labelled texts; group sums cover all documents, and all labels that
    may be read.  A text without words has only its site to speak for it beyond an empty text's evidence.  With
    ``carry`` the rows kept are returned as they are: all columns of ``docs`` stay, whatever their names.  Other columns
    are ignored; an empty table gives no rows.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    own = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)] if carry else []
    shaped = [F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), group_column(host, "host"), group_column(path, "path")]
    base = docs.select(*own, *shaped, F.col(text_col).cast("string").alias("text"))
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).cast("int").alias("label"))
    known = cut(known.join(base.filter("not held_out").select("doc_id").distinct(), "doc_id", "left_semi"))
    weights, rate = fit(base.select("doc_id", "text"), known, sample)
    prior = float(np.log(rate / (1 - rate)))
    chance = lambda odds: 1 / (1 + F.exp(-odds))
    # texts are read once: what later steps need is written beside the evidence
    if carry:
        at = docs.columns.index(text_col)
        read = written(evidence(base.drop("text"), weights, f"_{at}", True))
    else:
        read = written(evidence(base, weights, "text", False))
    # texts stay where they are unless there are more labels than may be broadcast
    own_label = F.when(~F.col("held_out"), F.col("label"))
    read = read.join(small_side(known, 2_000_000), "doc_id", "left")
    read = read.withColumn("p", F.coalesce(own_label.cast("double"), chance(F.col("evidence") + F.lit(prior)))).drop("label")
    paths = cut(read.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = float(min(max((whole.good or 0.5) / (whole.n or 1), 1e-6), 1 - 1e-6))
    to_global = strength(hosts, F.lit(mean))
    expected = (F.col("good") + to_global * mean) / (F.col("n") + to_global)
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), expected.alias("expected"))
    grouped = cut(paths.join(hosts, "host"))
    to_host = strength(grouped, F.col("expected"))
    sites = small_side(grouped.select("host", "path", F.col("n").alias("path_n"), F.col("good").alias("path_good"), "host_n", "host_good"))
    rows = read.join(sites, ["host", "path"])
    rows = rows.withColumn("host_rate", (F.col("host_good") - F.col("p") + to_global * mean) / (F.col("host_n") - 1 + to_global))
    rows = rows.withColumn("path_rate", (F.col("path_good") - F.col("p") + to_host * F.col("host_rate")) / (F.col("path_n") - 1 + to_host))
    bounded = F.greatest(F.least(F.col("path_rate"), F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = rows.withColumn("score", chance(F.col("evidence") + F.log(bounded / (1 - bounded))))
    rows = rows.withColumn("kept", F.col("score") >= threshold)
    if carry:
        return rows.filter("kept").select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
    return rows.select("doc_id", "held_out", "evidence", "host_rate", "path_rate", "score", "kept")
