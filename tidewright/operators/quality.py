"""Validity, reasons, dead letters and profiles of observations (FLT-*, AGG-02/03/14/15/16, CMP-03)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.times import aligned

# Bounds of a valid observation.
BOUNDS = {"temperature_c": (-90.0, 60.0), "humidity_pct": (0.0, 100.0), "latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0)}
REASONS = ("UNKNOWN_LOCATION", "INVALID_EVENT_TIME", "NON_HOURLY", "INVALID_COORDINATE", "INVALID_WEATHER_VALUE")


def valid_observation(identity: tuple[str, ...] = ("event_id", "location_id", "event_time"), bounds: dict[str, tuple[float, float]] | None = None, rain: str = "precipitation_mm") -> Column:
    """FLT-01, three-valued: null where a bounded value is null and nothing else fails."""
    rules = [F.col(c).isNotNull() for c in identity] + [F.col(c).between(lo, hi) for c, (lo, hi) in (bounds or BOUNDS).items()]
    return reduce(lambda a, b: a & b, [*rules, F.col(rain).isNotNull() & (F.col(rain) >= 0)])


def valid_history(rain: str = "precipitation_mm") -> Column:
    """FLT-03: identity, temperature and humidity bounds, rain not negative; no coordinates."""
    return valid_observation(bounds={c: BOUNDS[c] for c in ("temperature_c", "humidity_pct")}, rain=rain)


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """FLT-02: (valid, dead letters); null validity goes to the dead letters."""
    flagged = df.withColumn("is_valid", valid)
    return flagged.filter("is_valid"), flagged.filter(~F.coalesce("is_valid", F.lit(False)))


def reject_reason(known: Column, time: str = "event_time", latitude: str = "latitude", longitude: str = "longitude", values: tuple[str, ...] = (), cadence: int = 3600) -> Column:
    """FLT-06: the first reason that applies, in the order of REASONS, else null."""
    apart = (F.abs(F.col(latitude)) > 90) | (F.abs(F.col(longitude)) > 180)
    unusable = reduce(lambda a, b: a | b, (~finite(F.col(v)) for v in values), ~finite(F.col(latitude)) | ~finite(F.col(longitude)))
    checks = (~known, F.col(time).isNull(), ~aligned(F.col(time), cadence), apart, unusable)
    chain = F.when(checks[0], REASONS[0])
    for check, reason in zip(checks[1:], REASONS[1:]):
        chain = chain.when(check, reason)
    return chain


def all_errors(checks: dict[str, Column]) -> Column:
    """FLT-10: all codes whose check is true, sorted, joined by semicolons; empty text without any."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(check, code) for code, check in checks.items()))))), ";")


def mismatch(expected: dict[str, Column]) -> Column:
    """FLT-09: whether any column differs from what is expected, null-safely."""
    return reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(value) for c, value in expected.items()))


def profile(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """AGG-15: for each column (a row each) null, NaN and infinite counts, in one pass."""
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), F.count_if(x.isNull()).alias("nulls"), F.count_if(F.isnan(x)).alias("nans"), F.count_if(F.abs(x) == float("inf")).alias("infinities")))
    return df.groupBy(*(by or [])).agg(F.array(*cells).alias("cells")).select(*(by or []), F.inline("cells"))


def value_stats(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """AGG-16: min, max, mean and population deviation of each column (a row each), in one pass."""
    cells = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("most"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in columns]
    return df.groupBy(*(by or [])).agg(F.array(*cells).alias("cells")).select(*(by or []), F.inline("cells"))


def category_shares(df: DataFrame, column: str) -> DataFrame:
    """AGG-14: counts and fractions of a column's values, nulls as a value of their own."""
    counted = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("NULL")).alias("category")).agg(F.count("*").alias("n"))
    return counted.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def source_gate(df: DataFrame, key: str, time: str, required: list[str]) -> DataFrame:
    """CMP-03: one row of what must hold before features are built."""
    keys = df.groupBy(key, time).agg(F.count("*").alias("n"))
    duplicates = keys.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1)), F.lit(0)).cast("long").alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"))
    nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required), F.countDistinct(key).alias("keys"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    return duplicates.join(nulls)  # one row each
