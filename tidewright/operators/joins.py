"""Joins with their own semantics (JON-*, SET-04/05)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions up to so many bytes, by the optimizer's estimate, are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its size is known to be within bounds, else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def lookup(df: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """JON-01/09: inner join to a dimension, broadcast while it is small."""
    return df.join(small(dimension), keys)


def member_flag(df: DataFrame, known: DataFrame, keys: list[str], name: str = "known") -> DataFrame:
    """JON-02: whether the keys are in ``known``, which may repeat them."""
    marked = known.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(small(marked), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def without(df: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """JON-05: rows whose keys are in none of the others."""
    return reduce(lambda d, o: d.join(o, keys, "left_anti"), others, df)


def dirty_range(history: DataFrame, changed: DataFrame, key: str, time: str, reach_hours: int = 24) -> DataFrame:
    """JON-07: rows from a changed hour to ``reach_hours`` after it, once each.

    The changed hours of a key are joined by key and day, so a long history meets only the days it can touch.
    """
    days = F.sequence(F.to_date(time), F.to_date(F.col(time) + F.make_dt_interval(F.lit(0), F.lit(reach_hours))))
    asked = changed.select(key, F.col(time).alias("_from"), F.explode(days).alias("_day")).distinct()
    inside = (F.col(time) >= F.col("_from")) & (F.col(time) <= F.col("_from") + F.make_dt_interval(F.lit(0), F.lit(reach_hours)))
    return history.withColumn("_day", F.to_date(time)).join(asked, [key, "_day"]).filter(inside).drop("_day", "_from").dropDuplicates([key, time])


def late(df: DataFrame, state: DataFrame, key: str, time: str, retention_hours: int = 48) -> DataFrame:
    """JON-06, STR-09: rows older than the key's latest stored time by more than the retention."""
    latest = state.groupBy(key).agg(F.max(time).alias("_latest"))
    return df.join(latest, key).filter(F.col(time) < F.col("_latest") - F.make_dt_interval(F.lit(0), F.lit(retention_hours))).drop("_latest")


def compare(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-8) -> DataFrame:
    """JON-16/19: full outer comparison in one row: unmatched on either side, mismatches beyond the tolerance, largest difference."""
    a = left.select(*keys, *(F.col(v).alias(f"_l_{v}") for v in values), F.lit(True).alias("_l"))
    b = right.select(*keys, *(F.col(v).alias(f"_r_{v}") for v in values), F.lit(True).alias("_r"))
    gaps = [F.abs(F.col(f"_l_{v}") - F.col(f"_r_{v}")) for v in values]
    gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    halves = [F.col(f"_l_{v}").isNull() != F.col(f"_r_{v}").isNull() for v in values]
    differs = F.coalesce(gap > tolerance, F.lit(False)) | reduce(lambda x, y: x | y, halves)
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return a.join(b, keys, "full_outer").agg(F.count_if(both).alias("matched"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.count_if(both & differs).alias("mismatched"), F.max(gap).alias("max_abs_diff"))


def differences(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """SET-04: values of one side only, with the side."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def common_hour(df: DataFrame, key: str, time: str) -> DataFrame:
    """SET-05: the latest hour that all keys have, in one row (null without one)."""
    n = df.select(F.countDistinct(key).alias("keys"))
    full = df.groupBy(time).agg(F.countDistinct(key).alias("present")).join(n).filter("present = keys")  # one row
    return full.agg(F.max(time).alias("common_hour"))


def in_ranges(df: DataFrame, column: str, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the number of the range of ``column`` (numeric) that a row is in, larger values in later ranges.

    The ranges have about equally many rows each unless values repeat; equal values share one.  Their bounds come from a
    sketch and are fixed once, so that all uses of the result agree; rows find theirs by binary search.
    """
    from pyspark.ml.feature import Bucketizer

    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.stat.approxQuantile(column, [i / parts for i in range(1, parts)], 0.5 / parts) if parts > 1 else []
    inner = sorted({b for b in bounds if abs(b) < float("inf")})
    if not inner:
        return df.withColumn(name, F.lit(0))
    splits = [-float("inf"), *inner, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_cut", outputCol="_place", handleInvalid="keep")
    placed = cut.transform(df.withColumn("_cut", F.col(column).cast("double")))
    return placed.withColumn(name, F.col("_place").cast("int")).drop("_cut", "_place")


def running_max_before(df: DataFrame, order: str, value: str, name: str, ranges: int | None = None) -> DataFrame:
    """WIN-10: for each row the largest ``value`` of all rows before it in ``order`` (unique), without one task for all.

    Rows are range-partitioned by ``order``; ranges carry in the largest value of the ranges before them.
    """
    placed = in_ranges(df, order, "_range", ranges)
    tops = placed.groupBy("_range").agg(F.max(value).alias("_top"))
    carried = tops.select("_range", F.max("_top").over(Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inner = F.max(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_inner", inner).join(F.broadcast(carried), "_range").withColumn(name, F.greatest("_inner", "_carried")).drop("_range", "_inner", "_carried")
