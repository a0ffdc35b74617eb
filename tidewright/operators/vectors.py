"""Vectors by exact time (WIN-14): slot k holds the row of exactly k hours before, whatever lies between.

Positions can hide a gap behind a repeated hour; here each slot is looked up by its time in a RANGE frame of one instant,
so an absent hour is an absent slot, known by name.  All frames share one partitioning and order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.times import local_calendar
from .features import CURRENT, PLACE, Panel, columns


def slot_names(depth: int) -> list[str]:
    return [f"t-{k}h" for k in range(depth + 1)]


def with_slots(df: DataFrame, key: str, time: str, values: list[str], depth: int = 24) -> DataFrame:
    """``df`` with ``slots``: an array of depth + 1 structs of ``values``, null where no row is exactly so many hours back.

    (key, time) has to be unique; rows off the hour are rows like others and fill no slot of a whole hour.
    """
    by_time = Window.partitionBy(key).orderBy(F.unix_seconds(time))
    row = F.struct(*values)
    found = [F.first(row).over(by_time.rangeBetween(-3600 * k, -3600 * k)) for k in range(depth + 1)]
    return df.select("*", *(x.alias(f"_slot{k}") for k, x in enumerate(found))).withColumn("slots", F.array(*(f"_slot{k}" for k in range(depth + 1)))).drop(*(f"_slot{k}" for k in range(depth + 1)))


def absent(slots: str = "slots", depth: int = 24) -> Column:
    """The names of the slots without a row, nearest first."""
    return F.array_compact(F.array(*(F.when(F.col(slots)[k].isNull(), name) for k, name in enumerate(slot_names(depth)))))


def slot_map(value: str, slots: str = "slots", depth: int = 24) -> Column:
    """From a slot's name to its ``value``, of the slots that have a row."""
    entries = F.array(*(F.struct(F.lit(name), F.col(slots)[k][value]) for k, name in enumerate(slot_names(depth))))
    there = F.filter(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.struct(k.alias("k"), F.get(entries, k).alias("e"))), lambda x: F.get(F.col(slots), x["k"]).isNotNull())
    return F.map_from_entries(F.transform(there, lambda x: x["e"]))


def _over(c: str, n: int, operation: str) -> Column:
    """Mean, population deviation or sum of the last ``n`` slots, null unless all have a value."""
    x = [F.col("slots")[k][c].cast("double") for k in range(n)]
    total = reduce(lambda a, b: a + b, x)
    if operation == "sum":
        return total
    mean = total / n
    return mean if operation == "mean" else F.sqrt(reduce(lambda a, b: a + b, ((v - mean) * (v - mean) for v in x)) / n)


def slot_features(panel: Panel = Panel()) -> dict[str, Column]:
    """Lags, rolling values and differences of the feature contract, from ``slots`` and not from positions."""
    at = lambda c, k: F.col("slots")[k][c]
    out = {f"{short}_lag_{n}h": at(c, n) for c, (short, ns) in panel.lags.items() for n in ns}
    for c, (short, operations) in panel.rolls.items():
        for n in panel.roll_hours:
            out |= {f"{short}_sum_{n}h" if op == "sum" else f"{short}_roll_{op}_{n}h": _over(c, n, op) for op in operations}
    return out | {f"{short}_delta_{n}h": at(c, 0) - at(c, n) for c, short, ns in panel.deltas for n in ns}


def online_vectors(df: DataFrame, panel: Panel = Panel(), zone: str = "Asia/Ho_Chi_Minh") -> DataFrame:
    """key, time, status, absent and the features of the contract for each row, by exact time.

    HISTORY_GAP: a slot has no row (INSUFFICIENT_HISTORY where fewer than ``depth`` rows of the key come before);
    INVALID_FEATURES: all rows are there, a feature is null or not finite; READY else.  A feature whose own slots are all
    there has its value also where others lack.
    """
    measures = [*CURRENT, *PLACE]
    earlier = F.row_number().over(Window.partitionBy(panel.key).orderBy(F.unix_seconds(panel.time))) - 1
    made = with_slots(df.select(panel.key, panel.time, *measures, earlier.alias("_earlier")), panel.key, panel.time, measures, panel.depth)
    made = made.withColumns(slot_features(panel) | local_calendar(F.col(panel.time), zone)).withColumn("absent", absent("slots", panel.depth))
    names = columns(panel)
    sound = reduce(lambda a, b: a & b, (finite(F.col(c)) for c in names))
    status = F.when(F.col("_earlier") < panel.depth, "INSUFFICIENT_HISTORY").when(F.size("absent") > 0, "HISTORY_GAP").when(~sound, "INVALID_FEATURES").otherwise("READY")
    return made.select(panel.key, panel.time, status.alias("status"), "absent", *names)


def parity(online: DataFrame, offline: DataFrame, keys: list[str], names: list[str], tolerance: float = 1e-9) -> DataFrame:
    """JON-19 by feature: rows on both sides, and how many differ by more than ``tolerance`` or are null on one side only."""
    both = online.select(*keys, *(F.col(c).alias(f"_a{i}") for i, c in enumerate(names))).join(offline.select(*keys, *(F.col(c).alias(f"_b{i}") for i, c in enumerate(names))), keys)
    cells = []
    for i, c in enumerate(names):
        a, b = F.col(f"_a{i}").cast("double"), F.col(f"_b{i}").cast("double")
        apart = F.coalesce(F.abs(a - b) > tolerance, a.isNull() != b.isNull())
        cells.append(F.struct(F.lit(c).alias("feature"), F.count("*").alias("rows"), F.count_if(apart).alias("different")))
    return both.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
