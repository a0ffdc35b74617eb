"""Leakage-safe features of an hourly panel (WIN-*, CMP-01/02/04, PRJ-04).

All windows share one partitioning and order, so a panel is shuffled and sorted once however many features it gets.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.times import local_calendar
from ..sources.readers import require

# Which lags, rolling operations and differences each measure gets, in the order of the feature contract.
CURRENT = ("temperature_c", "humidity_pct", "precipitation_mm", "pressure_hpa", "wind_speed_kmh", "wind_gust_kmh")
PLACE = ("latitude", "longitude")
LAGS = {"temperature_c": ("temp", (1, 3, 6, 12, 24)), "humidity_pct": ("humidity", (1, 3, 6, 12, 24)), "pressure_hpa": ("pressure", (1, 3, 6, 12, 24)), "precipitation_mm": ("precipitation", (1, 3, 6, 24)), "wind_speed_kmh": ("wind_speed", (1, 3, 6, 24))}
ROLLS = {"temperature_c": ("temp", ("mean", "std")), "humidity_pct": ("humidity", ("mean", "std")), "pressure_hpa": ("pressure", ("mean", "std")), "precipitation_mm": ("precipitation", ("sum",)), "wind_speed_kmh": ("wind_speed", ("mean",))}
ROLL_HOURS = (3, 6, 24)
DELTAS = (("temperature_c", "temp", (1, 3)), ("humidity_pct", "humidity", (1, 3)), ("pressure_hpa", "pressure", (1, 3, 6)), ("wind_speed_kmh", "wind_speed", (1,)))
SPLITS = (("TRAIN", None, "2024-01-01"), ("VALIDATION", "2024-01-01", "2025-01-01"), ("TEST", "2025-01-01", "2026-01-01"))


@dataclass(frozen=True)
class Panel:
    key: str = "location_id"
    time: str = "event_time"
    lags: dict = field(default_factory=lambda: LAGS)
    rolls: dict = field(default_factory=lambda: ROLLS)
    roll_hours: tuple[int, ...] = ROLL_HOURS
    deltas: tuple = DELTAS
    depth: int = 24
    horizon: int = 1
    label: str = "temperature_c"

    @property
    def window(self):
        return Window.partitionBy(self.key).orderBy(self.time)


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def lagged(panel: Panel) -> dict[str, Column]:
    """WIN-01."""
    return {f"{short}_lag_{n}h": F.lag(c, n).over(panel.window) for c, (short, ns) in panel.lags.items() for n in ns}


def rolled(panel: Panel) -> dict[str, Column]:
    """WIN-02/03: over the last n rows, null until all n have a value."""
    kinds, out = {"mean": F.avg, "std": F.stddev_pop, "sum": F.sum}, {}
    for c, (short, operations) in panel.rolls.items():
        for n in panel.roll_hours:
            frame = panel.window.rowsBetween(-(n - 1), 0)
            for operation in operations:
                name = f"{short}_sum_{n}h" if operation == "sum" else f"{short}_roll_{operation}_{n}h"
                out[name] = F.when(F.count(c).over(frame) == n, kinds[operation](c).over(frame))
    return out


def differences(panel: Panel) -> dict[str, Column]:
    """WIN-04."""
    return {f"{short}_delta_{n}h": F.col(c) - F.lag(c, n).over(panel.window) for c, short, ns in panel.deltas for n in ns}


def gates(panel: Panel) -> dict[str, Column]:
    """WIN-05/06: whether the last ``depth`` hours and the next ``horizon`` are there without a gap; never null."""
    time = F.col(panel.time)
    before = F.lag(panel.time, panel.depth).over(panel.window)
    after = F.lead(panel.time, panel.horizon).over(panel.window)
    return {
        "history_complete": F.coalesce(before == time - hours(panel.depth), F.lit(False)),
        "target_complete": F.coalesce(after == time + hours(panel.horizon), F.lit(False)),
        "label_value": F.lead(panel.label, panel.horizon).over(panel.window),
    }


def split_name(target: Column, splits=SPLITS) -> Column:
    """CMP-02: by the target time, half-open."""
    chain = F
    for name, lo, hi in splits:
        inside = reduce(lambda a, b: a & b, [x for x in (target >= F.to_timestamp(F.lit(lo)) if lo else None, target < F.to_timestamp(F.lit(hi)) if hi else None) if x is not None], F.lit(True))
        chain = chain.when(inside, name)
    return chain


def columns(panel: Panel = Panel()) -> list[str]:
    """The model's features in the order of the contract: current values, place, calendar, lags, rolling values, differences."""
    calendar = ("local_hour", "local_day_of_week", "local_month", "local_day_of_year")
    cyclic = [f"{x}_{f}" for x in ("hour", "day_of_week", "day_of_year") for f in ("sin", "cos")]
    lags = [f"{short}_lag_{n}h" for short, ns in panel.lags.values() for n in ns]
    rolls = [f"{short}_{'sum' if op == 'sum' else f'roll_{op}'}_{n}h" for short, ops in panel.rolls.values() for n in panel.roll_hours for op in ops]
    deltas = [f"{short}_delta_{n}h" for _, short, ns in panel.deltas for n in ns]
    return [*CURRENT, *PLACE, *calendar, *cyclic, *lags, *rolls, *deltas]


def _shaped(df: DataFrame, panel: Panel, zone: str) -> tuple[DataFrame, Column]:
    """``df`` with all features and gates, and whether a row's numbers are all finite.  Absent columns are an error."""
    require(df, [panel.key, panel.time, panel.label, *CURRENT, *PLACE])
    made = lagged(panel) | rolled(panel) | differences(panel) | gates(panel) | local_calendar(F.col(panel.time), zone)
    shaped = df.select("*", *(v.alias(k) for k, v in made.items()))
    return shaped, reduce(lambda a, b: a & b, (finite(F.col(c)) for c in (*columns(panel), "label_value")))


def build(df: DataFrame, panel: Panel = Panel(), zone: str = "Asia/Ho_Chi_Minh", splits=SPLITS) -> DataFrame:
    """CMP-01: features, label and split of the rows whose history and target are whole and whose values are finite.

    (key, time) has to be unique: with a repeated and a missing hour together positions could pass the gate.
    """
    shaped, sound = _shaped(df, panel, zone)
    target = F.col(panel.time) + hours(panel.horizon)
    kept = shaped.filter(F.col("history_complete") & F.col("target_complete") & sound)
    kept = kept.withColumn("target_time", target).withColumn("split", split_name(target, splits))
    first = [panel.key, panel.time, "target_time", *(c for c in ("weather_code",) if c in df.columns)]
    return kept.select(*first, *columns(panel), F.col("label_value").alias(f"target_{panel.horizon}h"), "split")


def diagnostics(df: DataFrame, panel: Panel = Panel(), zone: str = "Asia/Ho_Chi_Minh") -> DataFrame:
    """CMP-01: one row of what ``build`` keeps and why it leaves the rest."""
    shaped, sound = _shaped(df, panel, zone)
    steps = {"_before": F.lag(panel.time, 1), "_after": F.lead(panel.time, panel.horizon), "_history": F.lag(panel.time, panel.depth)}
    shaped = shaped.select("*", *(v.over(panel.window).alias(k) for k, v in steps.items()))
    past, future, one = F.col("history_complete"), F.col("target_complete"), hours(1)
    return shaped.agg(
        F.count("*").alias("source_rows"),
        F.count_if(F.col("_before").isNotNull() & (F.col(panel.time) != F.col("_before") + one)).alias("source_gap_edges"),
        F.count_if(F.col("_history").isNotNull() & ~past).alias("history_continuity_violations"),
        F.count_if(~past).alias("history_ineligible_rows"),
        F.count_if(~future).alias("target_ineligible_rows"),
        F.count_if(past & future & ~sound).alias("invalid_feature_rows"),
        F.count_if(past & future & sound).alias("eligible_rows"),
        F.count_if(F.col("_after").isNotNull() & ~future).alias("target_gap_edges"),
    )


def gap_edges(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """WIN-07: per key, steps to the next row that are not one hour."""
    following = F.lead(panel.time).over(panel.window)
    steps = df.select(panel.key, (following.isNotNull() & (following != F.col(panel.time) + hours(1))).alias("edge"))
    return steps.groupBy(panel.key).agg(F.count("*").alias("n"), F.count_if("edge").alias("gap_edges"))


def grid(df: DataFrame, key: str, time: str) -> DataFrame:
    """WIN-13: every hour between a key's first and last; the values of absent hours are null."""
    spans = df.groupBy(key).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    every = spans.select(key, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias(time))
    return every.join(df, [key, time], "left")


def rolled_on_grid(df: DataFrame, key: str, time: str, value: str, rows: int, least: int) -> DataFrame:
    """WIN-12: mean, population deviation and sum of the last ``rows`` hours of the whole grid, null below ``least`` values."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(-(rows - 1), 0)
    enough = F.count(value).over(w) >= least
    shapes = {"mean": F.avg, "std": F.stddev_pop, "sum": F.sum}
    return grid(df, key, time).select(key, time, *(F.when(enough, f(value).over(w)).alias(f"{value}_{n}_{rows}") for n, f in shapes.items()))


def missing_hours(df: DataFrame, key: str, time: str) -> DataFrame:
    """SET-07."""
    spans = df.groupBy(key).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    every = spans.select(key, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias(time))
    return every.join(df.select(key, time), [key, time], "left_anti")


def gap_islands(df: DataFrame, key: str, time: str) -> DataFrame:
    """WIN-17: first and last missing hour and number of hours of each gap."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(time))
    marked = missing_hours(df, key, time).withColumn("island", F.unix_seconds(time) - rank * 3600)
    return marked.groupBy(key, "island").agg(F.min(time).alias("gap_start"), F.max(time).alias("gap_end"), F.count("*").alias("gap_hours")).drop("island")


def future_label(df: DataFrame, key: str, time: str, value: str, horizon: int, label: str = "label") -> DataFrame:
    """JON-11: the value exactly ``horizon`` hours later, never the nearest; rows without one go."""
    later = df.select(key, (F.col(time) - hours(horizon)).alias(time), F.col(value).alias(label))
    return df.join(later, [key, time])


def label_faults(features: DataFrame, source: DataFrame, key: str, time: str, target: str, label: str, value: str) -> DataFrame:
    """JON-10: how many labels are missing from, or differ from, the source at the target time."""
    there = source.select(key, F.col(time).alias(target), F.col(value).alias("truth"))
    return features.join(there, [key, target], "left").agg(F.count("*").alias("labels"), F.count_if(F.col("truth").isNull()).alias("missing"), F.count_if(F.col("truth") != F.col(label)).alias("different"))
