"""Which hours of a year are there, as bitmaps (CMP-17, SET-07): a bit an hour instead of a grid and an anti-join.

A bitmap of a key and year is built by one aggregate, merges with others of the same key and year by OR, and answers how
many hours there are, how many lack, and the first and last that lack, without a row for any hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year_start(year: Column) -> Column:
    """Seconds of the first instant of a year."""
    return F.unix_seconds(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def hours_of(year: Column) -> Column:
    return ((year_start(year + 1) - year_start(year)) / 3600).cast("long")


def presence(df: DataFrame, key: str, time: str) -> DataFrame:
    """key, year, bitmap and rows of the rows whose key and time are there and whose time is a whole hour."""
    sound = df.filter(F.col(key).isNotNull() & (F.unix_seconds(time) % 3600 == 0)).withColumn("year", F.year(time))
    hour = ((F.unix_seconds(time) - year_start(F.col("year"))) / 3600).cast("long") + 1  # bitmaps count from 1
    return sound.groupBy(key, "year").agg(F.bitmap_construct_agg(F.bitmap_bit_position(hour)).alias("bitmap"), F.count("*").alias("rows"))


def merged(parts: DataFrame, key: str) -> DataFrame:
    """``presence`` of all rows from those of some."""
    return parts.groupBy(key, "year").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("rows").alias("rows"))


def _byte(digits: Column, place: Column) -> Column:
    """A byte of a bitmap in hexadecimal, as a number."""
    return F.conv(F.substring(digits, 2 * place + 1, F.lit(2)), 16, 10).cast("int")


def _first_clear(digits: Column, end: Column) -> Column:
    """The lowest clear bit before ``end`` (a multiple of 8), null if all are set."""
    full = (F.length(F.regexp_extract(digits, "^(?:FF)*", 0)) / 2).cast("int")
    byte = _byte(digits, full)
    trailing = F.bit_count(F.shiftright(byte.bitwiseXOR(byte + 1), 1))
    return F.when(full * 8 < end, full * 8 + trailing)


def _last_clear(digits: Column, end: Column) -> Column:
    """The highest clear bit before ``end``, null if all are set."""
    full = (F.length(F.regexp_extract(digits, "(?:FF)*$", 0)) / 2).cast("int")
    place = (end / 8).cast("int") - full - 1
    clear = F.lit(255) - _byte(digits, place)
    top = F.floor(F.log2(clear.cast("double"))).cast("int")
    return F.when(place >= 0, place * 8 + top)


def coverage(bitmaps: DataFrame, key: str, known: DataFrame | None = None, years: list[int] | None = None) -> DataFrame:
    """key, year, rows, hours, missing_hours, first_missing and last_missing (times) and affected, by bits alone.

    With ``known`` (key) and ``years`` each of these keys has a row for each of these years and others have none; a year
    without rows lacks all its hours.
    """
    if known is not None and years is not None:
        every = known.select(key).filter(F.col(key).isNotNull()).distinct().select(key, F.explode(F.array(*map(F.lit, years))).alias("year"))
        bitmaps = every.join(bitmaps, [key, "year"], "left")
    expected = hours_of(F.col("year"))
    digits = F.coalesce(F.substring(F.hex("bitmap"), F.lit(1), (expected / 4).cast("int")), F.expr("repeat('00', 1098)"))
    told = bitmaps.withColumn("_bits", digits).withColumn("hours", F.coalesce(F.bitmap_count("bitmap"), F.lit(0)).cast("long"))
    time = lambda bit: F.timestamp_seconds(year_start(F.col("year")) + bit * 3600)
    whole = F.substring("_bits", F.lit(1), (expected / 4).cast("int"))
    return told.select(
        key, "year", F.coalesce("rows", F.lit(0)).alias("rows"), "hours", (expected - F.col("hours")).alias("missing_hours"),
        time(_first_clear(whole, expected)).alias("first_missing"), time(_last_clear(whole, expected)).alias("last_missing"), (F.col("hours") < expected).alias("affected"),
    )


def missing_gate(covered: DataFrame) -> DataFrame:
    """CMP-17's gate of missing hours, as a row (gate, n, result): n hours lack over all keys and years."""
    n = F.coalesce(F.sum("missing_hours"), F.lit(0))
    return covered.agg(n.alias("n")).select(F.lit("hours_missing").alias("gate"), "n", F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("result"))


def affected_keys(covered: DataFrame, key: str) -> DataFrame:
    """By year: hours that lack, and the keys they lack for, sorted; one list of keys a year."""
    lacks = F.when(F.col("affected"), F.col(key))
    return covered.groupBy("year").agg(F.sum("missing_hours").alias("missing_hours"), F.sort_array(F.collect_set(lacks)).alias("affected"))
