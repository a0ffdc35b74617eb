"""Toxicity from class-conditional Kneser-Ney bigram models.

Toxic and ordinary training texts each have a model P(word | word before), modified Kneser-Ney.  A class's words have
continuation estimates: how many different words they follow there, less discounts, completed by the continuation counts
of both classes together, which leave something for words never seen.  A class's pairs have their counts less three
discounts that the counts of counts give, completed by shared back-off counts: the pair's own Kneser-Ney estimate from
both classes together, adapted to the class by how much likelier that makes the word, and divided by what all words
after that context get so, which makes each model a distribution: its chances after any word add up to one.  So a rare
expression gets its chance from what both classes have, and one that neither has says nothing.

A text's log-likelihoods under both models, divided by its number of words, are compared.  As a few strong words drown
in a long text, a second mean, of the differences beyond ``STRONG`` (its root), goes with the first into a logistic fit
on training rows that the models have not seen.

The models are fitted on at most ``per_class`` labelled texts of each class, and on no more than ``sample_bytes`` of them
(those whose ids hash lowest), which bounds the tables that are broadcast: a pair, context or word takes some 20 bytes,
and 16 MB of texts have fewer than 3 million words.  Spark counts and joins; the driver gets the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords
from .frames import cut, over_texts, tidy

SIDES = ("toxic", "ordinary")
#: Differences (natural log) below this may be chance or topic.
STRONG = 2.5
#: A discount is this at least, so that each context leaves something.
LEAST = 0.05
#: What precedes a text's first word.
START = np.uint64(0x5354415254)


@dataclass
class Model:
    """log P(.. | toxic) - log P(.. | ordinary) by ascending hash: of pairs met, else a word's plus its context's.

    ``unmet`` is that of a word that training lacks; a context that it lacks adds nothing.
    """

    pairs: np.ndarray
    pair_ratios: np.ndarray
    contexts: np.ndarray
    context_ratios: np.ndarray
    words: np.ndarray
    word_ratios: np.ndarray
    unmet: float

    def ratios(self, before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """log P(word | word before, toxic) - log P(.., ordinary) of each word."""
        at, met = _find(self.words, hashes)
        out = np.where(met, _take(self.word_ratios, at), self.unmet)
        at, met = _find(self.contexts, before)
        out += np.where(met, _take(self.context_ratios, at), 0.0)
        at, met = _find(self.pairs, pair_hashes(before, hashes))
        return np.where(met, _take(self.pair_ratios, at), out)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[at] if len(values) else np.zeros((len(at), *values.shape[1:]), values.dtype)


def pair_hashes(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return bytewords.mix(bytewords.mix(before) ^ hashes)


def _sequences(column: pa.Array):
    """(first row, words before, words, where each text's begin) of slices."""
    for row, _, data, offsets in bytewords.text_slices(column, 1 << 20):
        words = bytewords.words(data, offsets, breaks=bytewords.MARKS)
        hashes = words.hashes()
        before = np.empty_like(hashes)
        before[1:] = hashes[:-1]
        starts = words.first[:-1][np.diff(words.first) > 0]
        before[starts] = START
        yield row, before, hashes, words.first


def bigram_counts(docs: DataFrame) -> DataFrame:
    """before, word, toxic and ordinary (counts) of ``docs`` (label, text)."""

    def run(batches):
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for row, before, hashes, first in _sequences(batch.column(1)):
                toxic = np.repeat(labels[row : row + len(first) - 1], np.diff(first)) == 1
                order = np.lexsort((hashes, before))
                before, hashes, toxic = before[order], hashes[order], toxic[order]
                new = np.flatnonzero(np.append(True, (np.diff(before) != 0) | (np.diff(hashes) != 0))) if len(hashes) else np.zeros(0, np.int64)
                sums = [np.add.reduceat(x.astype(np.int64), new) if len(new) else np.zeros(0, np.int64) for x in (toxic, ~toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (before[new].view(np.int64), hashes[new].view(np.int64), *sums)], ["before", "word", "toxic", "ordinary"])

    counted = over_texts(docs, run, "before long, word long, toxic long, ordinary long")
    return counted.groupBy("before", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def discounts(once: int, twice: int, thrice: int, four: int) -> tuple[float, float, float]:
    """What a count of one, of two, and of more loses, from how many entries have counts of one to four; fixed where one of these is missing."""
    if not (once and twice and thrice and four):
        return 0.5, 0.75, 0.75
    y = once / (once + 2 * twice)
    return max(1 - 2 * y * twice / once, LEAST), max(2 - 3 * y * thrice / twice, LEAST), max(3 - 4 * y * four / thrice, LEAST)


def counts_of_counts(df: DataFrame, columns: list[str]) -> list[tuple[float, float, float]]:
    """The discounts of each column."""
    row = df.agg(*(F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in columns for k in (1, 2, 3, 4))).first()
    return [discounts(*(row[f"{c}{k}"] for k in (1, 2, 3, 4))) for c in columns]


def discount(count: Column, by: tuple[float, float, float]) -> Column:
    return F.when(count == 0, 0.0).when(count == 1, by[0]).when(count == 2, by[1]).otherwise(by[2])


def word_chances(pairs: DataFrame) -> tuple[DataFrame, list[float]]:
    """word, p_toxic, p_ordinary (continuation estimates of the classes) and p_both (shared), and those of an unmet word.

    All three are distributions over the words met and one that stands for all others.
    """
    kinds = pairs.groupBy("word").agg(*(F.count_if(F.col(x) > 0).alias(x) for x in SIDES), F.count("*").alias("both"))
    kinds = cut(kinds)
    by = counts_of_counts(kinds, list(SIDES))
    lost = [F.coalesce(F.sum(discount(F.col(x), d)), F.lit(0.0)).alias(f"lost_{x}") for x, d in zip(SIDES, by)]
    sums = kinds.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in (*SIDES, "both")), *lost, F.count("*").alias("n")).first()
    total = sums.both + 0.5 * (sums.n + 1)
    shared, unmet = (F.col("both") + 0.5) / total, 0.5 / total
    chances, rest = [], []
    for x, d in zip(SIDES, by):
        left = sums[f"lost_{x}"] / sums[x] if sums[x] else 1.0  # a class without words has the shared estimate
        own = (F.col(x) - discount(F.col(x), d)) / sums[x] if sums[x] else F.lit(0.0)
        chances.append((own + left * shared).alias(f"p_{x}"))
        rest.append(left * unmet)
    return kinds.select("word", *chances, shared.alias("p_both")), [*rest, unmet]


def estimates(sample: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[float]]:
    """Pairs with the chance of their word in each class, contexts with what a pair not met gets of its word's chance, words and unmet ones.

    The shared estimate S(w | v) of both classes together is adapted to a class by how much likelier that makes w:
    S(w | v) * P(w) / Pboth(w) / Z(v), where Z(v) adds up to one what all words get, exactly: over the words met after v,
    and over all others by the part that S leaves to them, in which Pboth cancels and P adds up to one.
    """
    sides = [*SIDES, "both"]
    pairs = cut(bigram_counts(sample).withColumn("both", F.col("toxic") + F.col("ordinary")))
    words, unmet = word_chances(pairs)
    words = cut(words)
    by = counts_of_counts(pairs, sides)
    joined = pairs.join(words, "word")
    adapted = {x: F.col(f"p_{x}") / F.col("p_both") for x in SIDES}
    lost = [F.sum(discount(F.col(x), d)).alias(f"lost_{x}") for x, d in zip(sides, by)]
    met = [F.sum((F.col("both") - discount(F.col("both"), by[2])) * adapted[x]).alias(f"met_{x}") for x in SIDES]
    contexts = joined.groupBy("before").agg(*(F.sum(x).alias(f"n_{x}") for x in sides), *lost, *met)
    leaves = {x: F.when(F.col(f"n_{x}") > 0, F.col(f"lost_{x}") / F.col(f"n_{x}")).otherwise(1.0) for x in sides}
    norms = [((F.col(f"met_{x}") + F.col("lost_both")) / F.col("n_both")).alias(f"norm_{x}") for x in SIDES]
    contexts = cut(contexts.select("before", *(F.col(f"n_{x}") for x in sides), *(v.alias(f"leaves_{x}") for x, v in leaves.items()), *norms))
    joined = joined.join(contexts, "before")
    kept = {x: F.when(F.col(f"n_{x}") > 0, (F.col(x) - discount(F.col(x), d)) / F.col(f"n_{x}")).otherwise(0.0) for x, d in zip(sides, by)}
    shared = kept["both"] + F.col("leaves_both") * F.col("p_both")
    chances = [(kept[x] + F.col(f"leaves_{x}") * shared * adapted[x] / F.col(f"norm_{x}")).alias(f"c_{x}") for x in SIDES]
    rest = [(F.col(f"leaves_{x}") * F.col("leaves_both") / F.col(f"norm_{x}")).alias(f"c_{x}") for x in SIDES]
    return joined.select("before", "word", *chances), contexts.select("before", *rest), words.select("word", *(F.col(f"p_{x}").alias(f"c_{x}") for x in SIDES)), unmet


def fit_models(sample: DataFrame) -> Model:
    """A model of all pairs, contexts and words of ``sample`` (label, text); the driver gets 12 bytes for each."""
    *tables, unmet = estimates(sample)

    def hashed(batches):
        for batch in batches:
            keys = [batch.column(i).to_numpy().view(np.uint64) for i in range(batch.num_columns - 1)]
            key = pair_hashes(*keys) if len(keys) == 2 else keys[0]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(batch.num_columns - 1)], ["key", "ratio"])

    ratio = (F.log("c_toxic") - F.log("c_ordinary")).cast("float").alias("ratio")
    found = []
    for df in tables:
        rows = df.select(*(c for c in df.columns if not c.startswith("c_")), ratio).mapInArrow(hashed, "key long, ratio float").toArrow()
        key, ratios = rows.column("key").to_numpy().view(np.uint64), rows.column("ratio").to_numpy()
        del rows
        order = np.argsort(key)
        found += [key[order], ratios[order]]
    tidy()
    return Model(*found, float(np.log(unmet[0]) - np.log(unmet[1])))


def normalised_ratios(docs: DataFrame, model, carried: list[str]) -> DataFrame:
    """The carried columns of ``docs`` with the mean ratio of all words of a text and the root of their mean ratio beyond STRONG (0 without words)."""
    names = [*carried, "ratio", "strong"]
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in docs.select(*carried).schema) + ", ratio double, strong double"

    def run(batches):
        for batch in batches:
            out = np.zeros((2, batch.num_rows))
            for row, before, hashes, first in _sequences(batch.column(len(carried))):
                ratios = model.value.ratios(before, hashes)
                for k, x in enumerate((ratios, np.maximum(ratios - STRONG, 0))):
                    sums = np.concatenate(([0.0], np.cumsum(x, dtype=float)))[first]
                    out[k, row : row + len(first) - 1] = np.diff(sums) / np.maximum(np.diff(first), 1)
            out[1] = np.sqrt(np.maximum(out[1], 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carried))), pa.array(out[0]), pa.array(out[1])], names)

    return over_texts(docs.select(*carried, "text"), run, schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Slopes and intercept by damped Newton steps, with one pseudo-row of either class; the ridge is on scaled columns."""
    if not len(x):
        return np.zeros(x.shape[1] + 1)
    centre, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.hstack((np.vstack(((x - centre) / spread, np.zeros((2, x.shape[1])))), np.ones((len(x) + 2, 1))))
    y = np.append(y, [0.0, 1.0])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-9)
    w = np.zeros(z.shape[1])
    loss = lambda w: (np.logaddexp(0, z @ w) - y * (z @ w)).sum() + 0.5 * (penalty * w * w).sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    slopes = w[:-1] / spread
    return np.append(slopes, w[-1] - slopes @ centre)


def score(docs: DataFrame, labels: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text",
          per_class: int = 5_000, sample_bytes: int = 16 << 20, calibration: int = 10_000, cutoff: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted (1 from ``cutoff`` on), one row per input row.

    ``labels`` has doc_id and toxic; labels of rows for which ``held_out`` is true, and null labels, are not read; of a
    document's repeated labels the largest counts.  A null or empty text gets the score of a neutral one.  Without
    labels of both classes the score comes from their counts alone.  Other columns are ignored.
    """
    held = F.coalesce(held_out, F.lit(False))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    lengths = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    ids = docs.filter("not held_out").select("doc_id", lengths).join(known, "doc_id").groupBy("doc_id", "label").agg(F.sum("size").alias("size"))
    # three parts of four fit the models, the fourth fits the scale
    order = F.xxhash64("doc_id", F.lit(9))
    fourth = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0

    def first(k: int) -> DataFrame:
        """Of at most ``per_class`` ids, in order, those that fit into ``sample_bytes`` (one at least)."""
        picked = ids.filter(~fourth & (F.col("label") == k)).select("doc_id", "label", "size", order.alias("rank")).orderBy("rank", "doc_id").limit(per_class)
        before = Window.partitionBy("label").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        return picked.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).filter((F.col("before") == 0) | (F.col("before") + F.col("size") <= sample_bytes)).select("doc_id", "label", F.lit(True).alias("fits"))

    measured = ids.filter(fourth).select("doc_id", "label", order.alias("rank")).orderBy("rank", "doc_id").limit(calibration)
    both = first(1).unionByName(first(0)).unionByName(measured.select("doc_id", "label", F.lit(False).alias("fits")))
    texts = cut(docs.join(F.broadcast(both), "doc_id").select("label", "fits", "text"))  # at most 2 * per_class + calibration ids
    model = docs.sparkSession.sparkContext.broadcast(fit_models(texts.filter("fits").select("label", "text")))
    seen = normalised_ratios(texts.filter("not fits"), model, ["label"]).toArrow()
    weights = logistic(np.stack([seen.column(x).to_numpy() for x in ("ratio", "strong")], axis=1), seen.column("label").to_numpy().astype(float))
    scored = normalised_ratios(docs, model, ["doc_id", "held_out"])
    odds = F.lit(float(weights[0])) * F.col("ratio") + F.lit(float(weights[1])) * F.col("strong") + F.lit(float(weights[2]))
    return scored.select("doc_id", "held_out", (1 / (1 + F.exp(-odds))).alias("score")).withColumn("predicted", F.when(F.col("score") >= cutoff, 1).otherwise(0))
