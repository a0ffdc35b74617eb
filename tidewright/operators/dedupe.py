"""Duplicates, conflicts and canonical rows (STR-02, AGG-04..08, WIN-08/09, CMP-09/12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """WIN-08: the first row of each key; ``order`` has to break ties."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def within_watermark(df: DataFrame, event_id: str, time: str, delay: str = "10 minutes", *order: Column) -> DataFrame:
    """STR-02: duplicates within the watermark on a stream; the first row by ``order`` on a batch."""
    if df.isStreaming:
        return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([event_id])
    return first_by(df, [event_id], *(order or (F.col(time), F.struct(*df.columns))))


def newest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-09: the union by name in which a new row takes the place of an old one."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return first_by(both, keys, F.col("_age")).drop("_age")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-07: keys met more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def excess(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-08: rows beyond the first of each key, in one row."""
    return repeated(df, keys).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("excess_rows"))


def versions(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """AGG-05: rows and distinct payloads of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(payload).alias("versions"))


def conflict_totals(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """AGG-06: duplicate rows of keys with one payload, and keys and rows with several."""
    one = F.col("versions") <= 1
    sums = {"duplicate_rows": F.when(one, F.col("n") - 1), "conflict_keys": F.when(~one, 1), "conflict_rows": F.when(~one, F.col("n"))}
    return versions(df, keys, payload).agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in sums.items()))


def canonical(df: DataFrame, keys: list[str], payload: str, *arrival: Column) -> DataFrame:
    """CMP-09: each row with its outcome: CANONICAL (first arrival), DUPLICATE (same payload) or REVISION (another)."""
    window = Window.partitionBy(*keys).orderBy(*arrival)
    ranked = df.withColumn("arrival_rank", F.row_number().over(window)).withColumn("canonical_payload", F.first(payload).over(window))
    outcome = F.when(F.col("arrival_rank") == 1, "CANONICAL").when(F.col(payload).eqNullSafe(F.col("canonical_payload")), "DUPLICATE").otherwise("REVISION")
    return ranked.withColumn("outcome", outcome)


def one_signature(df: DataFrame, key: str, signature: Column) -> DataFrame:
    """CMP-12: per key the smallest signature, rows, and whether signatures differ."""
    return df.groupBy(key).agg(F.min(signature).alias("signature"), F.count("*").alias("n"), (F.countDistinct(signature) > 1).alias("conflict"))
