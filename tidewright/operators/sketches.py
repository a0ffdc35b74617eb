"""Quantiles of moving windows from mergeable sketches (AGG-09, CMP-13): values are read once, however long the windows.

Each hour keeps a KLL sketch beside its count, sum and extremes.  Hours are merged upwards into aligned blocks of 2, 4, 8
... hours, and a window is put together from the few blocks that cover it exactly, two of a size at most.  So a window of
168 hours merges some ten sketches instead of 168, and no value is repeated for the windows it belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite

K = 800
#: Hours that exact ranks of windows take together.
TILE = 8


def rank_error(k: int = K) -> float:
    """How far a quantile's rank is from the wanted share, with 99 % confidence; merging doesn't add to it.

    Fewer than ``k`` values are kept as they are.  Three times this is practically never exceeded.
    """
    return 2.296 / k**0.9723


def _parts(value: Column, k: int) -> list[Column]:
    return [F.kll_sketch_agg_double(value, k).alias("sketch"), F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")]


def _merged(k: int) -> list[Column]:
    return [F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")]


def hourly(df: DataFrame, by: list[str], time: str, value: str, k: int = K) -> DataFrame:
    """by, hour (a number), sketch, n, total, least and most of the finite values; hours without one are not there."""
    x = F.col(value).cast("double")
    return df.filter(finite(x)).groupBy(*by, F.floor(F.unix_seconds(time) / 3600).alias("hour")).agg(*_parts(x, k))


def levels(span_hours: int) -> int:
    return max(1, span_hours.bit_length())


def blocks(hours: DataFrame, by: list[str], span_hours: int, k: int = K) -> DataFrame:
    """``hourly`` rows merged into aligned blocks: level 0 are the hours, a block of level n covers 2 ** n of them."""
    every = F.sequence(F.lit(0), F.lit(levels(span_hours) - 1))
    placed = hours.withColumn("level", F.explode(every)).withColumn("block", F.floor(F.col("hour") / F.pow(F.lit(2.0), "level")).cast("long"))
    return placed.groupBy(*by, "level", "block").agg(*_merged(k))


def cover(end: Column, span_hours: int) -> Column:
    """The blocks (level, block) that cover the hours from ``end - span_hours + 1`` to ``end``, each hour once."""
    found, low, high = [], end - span_hours + 1, end + 1
    for level in range(levels(span_hours)):
        size = 1 << level
        first, last = F.ceil(low / size), F.floor(high / size)  # whole blocks of this size: first up to last, without last
        for odd, block in ((first % 2 != 0, first), (last % 2 != 0, last - 1)):
            found.append(F.when((first < last) & odd, F.struct(F.lit(level).alias("level"), block.cast("long").alias("block"))))
    return F.array_compact(F.array(*found))


def windows(merged: DataFrame, by: list[str], ends: DataFrame, span_hours: int, keys: list[str] | None = None, k: int = K) -> DataFrame:
    """by, end (an hour's number), sketch, n, total, least and most of the ``span_hours`` that end with each of ``ends``.

    ``ends`` has ``keys`` (columns among ``by``, all by default) and end.  A window without values is not there.
    """
    keys = by if keys is None else keys
    asked = ends.select(*keys, "end", F.inline(cover(F.col("end"), span_hours)))
    asked = asked.hint("merge")  # the optimizer takes the exploded covers for as small as the ends and would broadcast them
    return asked.join(merged, [*keys, "level", "block"]).groupBy(*by, "end").agg(*_merged(k))


def quantile(share: float, sketch: str = "sketch") -> Column:
    """The smallest kept value whose rank reaches ``share``."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def ranks(values: DataFrame, by: list[str], value: str, found: DataFrame) -> DataFrame:
    """``found`` (by, share, quantile) with n, below and up_to: how many of ``values`` are below, and not above, the quantile."""
    met = values.filter(finite(F.col(value))).join(found, by)
    x, q = F.col(value).cast("double"), F.col("quantile")
    return met.groupBy(*by, "share", "quantile").agg(F.count("*").alias("n"), F.count_if(x < q).alias("below"), F.count_if(x <= q).alias("up_to"))


def tiles(end: Column, span: Column) -> Column:
    """Tiles (size, at) of TILE hours and single hours that cover the ``span`` hours up to ``end``, each hour once."""
    low = end - span + 1
    first, last = F.ceil(low / TILE), F.floor((end + 1) / TILE)  # whole tiles: first up to last, without last
    hours = F.filter(F.sequence(low, end), lambda h: (F.floor(h / TILE) < first) | (F.floor(h / TILE) >= last))
    whole = F.filter(F.sequence(F.floor(low / TILE), F.floor(end / TILE)), lambda t: (t >= first) & (t < last))
    return F.concat(F.transform(hours, lambda h: F.struct(F.lit(1).alias("size"), h.alias("at"))), F.transform(whole, lambda t: F.struct(F.lit(TILE).alias("size"), t.alias("at"))))


def window_ranks(values: DataFrame, by: list[str], time: str, value: str, found: DataFrame) -> DataFrame:
    """``ranks`` of moving windows: ``found`` (by, end, span, share, quantile) with n, below and up_to of its ``span`` hours' values.

    No value is repeated for the windows that hold it: it lies in its hour and its tile, where quantiles are put among
    the values in order, and running counts tell how many are before them.  A window's counts are those of its parts.
    """
    hour, x = F.floor(F.unix_seconds(time) / 3600), F.col(value).cast("double")
    part = F.array(F.struct(F.lit(1).alias("size"), hour.alias("at")), F.struct(F.lit(TILE).alias("size"), F.floor(hour / TILE).alias("at")))
    met = values.filter(finite(x)).select(*by, x.alias("quantile"), F.lit(1).alias("kind"), F.inline(part))
    asked = found.select(*by, "end", "span", "share", "quantile", F.inline(tiles(F.col("end"), F.col("span"))))
    asked = asked.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(2))))  # before and after the values that equal it
    order = Window.partitionBy(*by, "size", "at").orderBy("quantile", "kind")
    counted = F.count_if(F.col("kind") == 1)
    placed = asked.unionByName(met, allowMissingColumns=True).withColumn("here", counted.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.withColumn("all", counted.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).filter("kind <> 1")
    below, after = F.col("kind") == 0, F.col("kind") == 2
    sums = [F.sum(F.when(side, F.col(c))).alias(name) for name, side, c in (("n", below, "all"), ("below", below, "here"), ("up_to", after, "here"))]
    return placed.groupBy(*by, "end", "span", "share", "quantile").agg(*sums)


def within(error: float) -> Column:
    """Whether the share is within ``error`` of the ranks that ``ranks`` found for its quantile; a value's own step is allowed."""
    low, high = (F.col("below") - 1) / F.col("n") - error, (F.col("up_to") + 1) / F.col("n") + error
    return (F.col("share") >= low) & (F.col("share") <= high)
