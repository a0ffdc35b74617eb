"""Exact histograms of encoded lengths and what they answer for every context limit.

Texts are encoded where they lie and only their lengths leave a task; documents are then aggregated by group and length.
Suffix sums run inside ranges of ``RANGE`` lengths and over the ranges' totals, so no task sees all lengths of a group.
Between two lengths of the histogram all answers are linear in the limit, so a row for each length answers every limit.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ranks
from .frames import cut, over_texts

RANGE = 1024


@lru_cache(1)
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def lengths(docs: DataFrame, *, vocabulary: str, pattern: str, text_col: str = "text", group_col: str = "lang") -> DataFrame:
    """group and length (tokens) of every row; a null or empty text has 0."""

    def run(batches):
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.zeros(len(texts), np.int64)
            for start in range(0, len(texts), 64):
                some = [x or "" for x in texts.slice(start, 64).to_pylist()]
                sizes[start : start + len(some)] = [len(x) for x in encoder.encode_ordinary_batch(some, num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], ["group", "length"])

    return over_texts(docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("group"), F.col(text_col).cast("string").alias("text")), run, "group string, length long")


def histogram(measured: DataFrame) -> DataFrame:
    """group, length and n_docs, summed in each task before the shuffle."""
    return measured.groupBy("group", "length").agg(F.count("*").alias("n_docs"))


def answers(counted: DataFrame) -> DataFrame:
    """For each group and length of a histogram, taken as the context limit: exact totals.

    n_docs of that length, docs_over and tokens_over of longer documents, total_docs, total_tokens, kept_tokens (all
    documents cut off at the limit) and share_within (of documents no longer than the limit: the limit is the quantile
    of that share).
    """
    counted = counted.withColumn("range", F.floor(F.col("length") / RANGE)).withColumn("tokens", F.col("n_docs") * F.col("length"))
    after = Window.partitionBy("group", "range").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = counted.select("*", *(F.coalesce(F.sum(x).over(after), F.lit(0)).alias(f"{y}_inside") for x, y in (("n_docs", "docs"), ("tokens", "tokens"))))
    ranges = counted.groupBy("group", "range").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    beyond = Window.partitionBy("group").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("group")
    ranges = ranges.select("group", "range", *(F.coalesce(F.sum(x).over(beyond), F.lit(0)).alias(f"{x}_beyond") for x in ("docs", "tokens")), *(F.sum(x).over(whole).alias(f"total_{x}") for x in ("docs", "tokens")))
    docs_over, tokens_over = F.col("docs_inside") + F.col("docs_beyond"), F.col("tokens_inside") + F.col("tokens_beyond")
    return inside.join(ranges, ["group", "range"]).select(
        "group",
        F.col("length").alias("context_limit"),
        "n_docs",
        docs_over.alias("docs_over"),
        tokens_over.alias("tokens_over"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - tokens_over + docs_over * F.col("length")).alias("kept_tokens"),
        ((F.col("total_docs") - docs_over) / F.col("total_docs")).alias("share_within"),
    )


def token_counts(docs: DataFrame, *, vocabulary: str, pattern: str, text_col: str = "text", group_col: str = "lang") -> DataFrame:
    """``answers`` of whole texts by group; a null group is the group ''; other columns are ignored; an empty table gives no rows.

    The histogram, which both branches of ``answers`` read, is computed once.
    """
    measured = lengths(docs, vocabulary=vocabulary, pattern=pattern, text_col=text_col, group_col=group_col)
    return answers(cut(histogram(measured)))
