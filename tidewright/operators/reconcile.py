"""Reconciliation of a load by multiset fingerprints (CMP-16).

Both sides are added up to counts and order-free digests by group (key and year): two sums and two exclusive-ors of
row hashes.  Equal digests mean equal multisets of rows, so only groups that differ are read again, row by row.  Digests
of parts add up, so a side may be kept by file or by day and never be read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import small

SUMS = ("n", "sum_a", "sum_b")


def row_hash(columns: list[str], seed: str) -> Column:
    """64 bits of a row's columns; a null is a value of its own and its place counts."""
    told = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(seed), *told)


def fingerprints(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n, sum_a, sum_b, xor_a and xor_b of the rows of each group."""
    rows = df.select(*by, row_hash(columns, "a").alias("_a"), row_hash(columns, "b").alias("_b"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), wide("_a").alias("sum_a"), wide("_b").alias("sum_b"), F.bit_xor("_a").alias("xor_a"), F.bit_xor("_b").alias("xor_b"))


def added(parts: DataFrame, by: list[str]) -> DataFrame:
    """The fingerprints of all rows from those of disjoint parts."""
    return parts.groupBy(*by).agg(*(F.sum(c).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in SUMS), *(F.bit_xor(c).alias(c) for c in ("xor_a", "xor_b")))


def compare_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """by, left_n, right_n and whether the two fingerprints differ; null groups are equal to each other."""
    sides = []
    for name, side in (("left", left), ("right", right)):
        digest = F.struct(*(c for c in side.columns if c not in by))
        sides.append(side.select(F.struct(*by).alias("_group"), F.col("n").alias(f"{name}_n"), digest.alias(f"_{name}")))
    both = sides[0].join(sides[1], sides[0]["_group"].eqNullSafe(sides[1]["_group"]), "full_outer")
    group = F.coalesce(sides[0]["_group"], sides[1]["_group"])
    counts = (F.coalesce(f"{name}_n", F.lit(0)).alias(f"{name}_n") for name in ("left", "right"))
    return both.select(*(group[c].alias(c) for c in by), *counts, (~F.col("_left").eqNullSafe(F.col("_right"))).alias("differs"))


def _by_key(df: DataFrame, by: list[str], keys: list[str], columns: list[str], name: str) -> DataFrame:
    """For each key its rows and a digest of the set of its different rows."""
    rows = df.select(F.struct(*by, *keys).alias("_key"), row_hash(columns, "a").alias("_a"), row_hash(columns, "b").alias("_b"))
    once = rows.groupBy("_key", "_a", "_b").agg(F.count("*").alias("_n"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    times = F.struct(wide("_a").alias("a"), wide("_b").alias("b"), F.count("*").alias("kinds"))
    often = F.sum(F.col("_a").cast("decimal(20,0)") * F.col("_n"))
    return once.groupBy("_key").agg(F.sum("_n").alias(f"{name}_n"), times.alias(f"_{name}_set"), often.alias(f"_{name}_all"))


def reconcile(left: DataFrame, right: DataFrame, by: list[str], keys: list[str], columns: list[str]) -> DataFrame:
    """by, keys, left_n, right_n and verdict of each key whose rows (``columns``) differ, from groups that differ alone.

    LOST: on the left only; UNEXPECTED: on the right only; REPEATED: the same rows, in other numbers; CHANGED: other rows.
    Groups and keys may be null and a key may have several rows.
    """
    groups = compare_groups(fingerprints(left, by, columns), fingerprints(right, by, columns), by)
    asked = groups.filter("differs").select(F.struct(*by).alias("_group"))
    told = []
    for name, side in (("left", left), ("right", right)):
        mine = side.withColumn("_of", F.struct(*by))
        told.append(_by_key(mine.join(small(asked), mine["_of"].eqNullSafe(asked["_group"]), "left_semi"), by, keys, columns, name))
    both = told[0].join(told[1], told[0]["_key"].eqNullSafe(told[1]["_key"]), "full_outer")
    key = F.coalesce(told[0]["_key"], told[1]["_key"])
    same = F.col("_left_set").eqNullSafe(F.col("_right_set"))
    alike = same & F.col("left_n").eqNullSafe(F.col("right_n")) & F.col("_left_all").eqNullSafe(F.col("_right_all"))
    verdict = F.when(F.col("right_n").isNull(), "LOST").when(F.col("left_n").isNull(), "UNEXPECTED").when(same, "REPEATED").otherwise("CHANGED")
    counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("left_n", "right_n"))
    return both.filter(~alike).select(*(key[c].alias(c) for c in [*by, *keys]), *counts, verdict.alias("verdict"))
