"""Error metrics, distributions and roll-ups of forecasts (AGG-10..24, WIN-15/16, CMP-13/14/27).

Regression metrics are kept as sufficient statistics, so hours add up to days and weeks without touching rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite, ratio
from .joins import in_ranges, small

SUMS = ("n", "abs_error", "sq_error", "error", "y", "y_sq")


def sufficient(prediction: str = "prediction", actual: str = "reference", centre: float = 0.0) -> list[Column]:
    """n, Σ|e|, Σe², Σe, Σy, Σy² with e = prediction - actual and y = actual - centre.

    Only the spread of y is ever used, so ``centre`` changes no metric; one near the mean keeps r2 from cancelling where
    the mean is large beside the spread.  Sums that are added up need the same centre.
    """
    e, y = F.col(prediction) - F.col(actual), F.col(actual) - centre
    return [F.count(e).alias("n"), F.sum(F.abs(e)).alias("abs_error"), F.sum(e * e).alias("sq_error"), F.sum(e).alias("error"), F.sum(F.when(e.isNotNull(), y)).alias("y"), F.sum(F.when(e.isNotNull(), y * y)).alias("y_sq")]


def regression(prefix: str = "") -> dict[str, Column]:
    """AGG-18 from sufficient statistics: mae, rmse, bias and r2 (null for fewer than two rows or a constant reference)."""
    c = {k: F.col(k).cast("double") for k in SUMS}
    n = F.nullif(c["n"], F.lit(0.0))
    spread = c["y_sq"] - c["y"] * c["y"] / n
    flat = spread <= 1e-12 * F.greatest(c["y_sq"], F.lit(1e-300))
    r2 = F.when((c["n"] >= 2) & ~flat, 1 - c["sq_error"] / spread)
    return {f"{prefix}mae": c["abs_error"] / n, f"{prefix}rmse": F.sqrt(c["sq_error"] / n), f"{prefix}bias": c["error"] / n, f"{prefix}r2": r2}


def skill(model: Column, base: Column) -> dict[str, Column]:
    """AGG-19: improvement, percent and skill; null on a zero or missing base."""
    return {"improvement": base - model, "improvement_pct": ratio(base - model, base) * 100.0, "skill": 1.0 - ratio(model, base)}


def quality_status(model: Column, base: Column, n: Column, least: int = 1) -> Column:
    """CMP-14."""
    unknown = (n < least) | model.isNull() | base.isNull()
    return F.when(unknown, "INSUFFICIENT_SAMPLE").when(model < base, "MODEL_BEATS_PERSISTENCE").when(model > base, "MODEL_TRAILS_PERSISTENCE").otherwise("MODEL_EQUALS_PERSISTENCE")


def usable(df: DataFrame, columns: list[str]) -> DataFrame:
    """Evaluated rows whose numbers are all finite."""
    for c in columns:
        df = df.filter(finite(F.col(c)))
    return df.filter("status = 'EVALUATED'") if "status" in df.columns else df


def distribution(value: str) -> list[Column]:
    """AGG-12: count, mean, population deviation, extremes and exact percentiles of the finite values."""
    x = F.when(finite(F.col(value)), F.col(value).cast("double"))
    p = F.percentile(x, [0.05, 0.5, 0.95])
    return [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), p[0].alias("p05"), p[1].alias("p50"), p[2].alias("p95"), F.max(x).alias("max")]


def distributions(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """AGG-12/13: a row of ``distribution`` for each column."""
    long = df.select(*(by or []), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_value")) for c in columns))))
    return long.groupBy(*(by or []), "column").agg(*distribution("_value"))


def train_bounds(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """AGG-13: p01 and p99 of the finite values of each column, of TRAIN rows only."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_value")) for c in columns]
    long = df.filter(F.col(split) == "TRAIN").select(F.inline(F.array(*cells))).filter(finite(F.col("_value")))
    found = at_ranks(long, "_value", lambda n: [cut((n - 1) * s) for s in (0.01, 0.99) for cut in (F.floor, F.ceil)], ["column"])
    p01, p99 = (_between(i, share) for i, share in enumerate((0.01, 0.99)))
    return found.select("column", F.col("n").alias("count"), p01.alias("p01"), p99.alias("p99"))


def at_ranks(df: DataFrame, value: str, ranks: Callable[[Column], list[Column]], by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Order statistics by group: ``n`` rows and ``values``, those at the ranks (from 0) that ``ranks`` gives for ``n``.

    Counts of ranges say which ranges hold a wanted rank; only their values are counted, then ordered within the range.
    So no task sees a group, however large, and a value that repeats is one row.  Nulls are left out; groups may be null.
    """
    group = F.struct(*by) if by else F.lit(0)
    rows = df.filter(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).alias("_v"))
    counted = in_ranges(rows, "_v", "_r", ranges).groupBy("_g", "_r", "_v").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy("_g")
    sizes = counted.groupBy("_g", "_r").agg(F.sum("_c").alias("_c"))
    upto = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select("_g", "_r", "_c", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("_n"))
    asked = placed.select("_g", "_r", "_c", "_before", "_n", F.posexplode(F.array(*(k.cast("long") for k in ranks(F.col("_n"))))).alias("_i", "_k"))
    asked = asked.filter((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c"))).drop("_c")
    wanted = counted.join(asked.select("_g", "_r").distinct(), ["_g", "_r"], "left_semi")
    inside = Window.partitionBy("_g", "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    summed = wanted.withColumn("_last", F.sum("_c").over(inside))
    met = summed.join(asked, ["_g", "_r"]).withColumn("_k", F.col("_k") - F.col("_before"))
    hit = met.filter((F.col("_k") < F.col("_last")) & (F.col("_k") >= F.col("_last") - F.col("_c")))
    out = hit.groupBy("_g").agg(F.max("_n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("values"))
    return out.select(*(F.col("_g")[c].alias(c) for c in by or []), "n", "values")


def nearest_rank(df: DataFrame, value: str, share: float, by: list[str] | None = None) -> DataFrame:
    """AGG-11: the value at index int((n - 1) * share + 0.5) of the sorted values; no row where there is none."""
    found = at_ranks(df, value, lambda n: [F.floor((n - 1) * share + 0.5)], by)
    return found.select(*(by or []), F.col("values")[0].alias("value"))


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """AGG-10: ``percentiles``, interpolated between ranks as ``F.percentile`` does, of groups too large for one task."""
    found = at_ranks(df, value, lambda n: [cut((n - 1) * s) for s in shares for cut in (F.floor, F.ceil)], by)
    return found.select(*(by or []), F.array(*(_between(i, share) for i, share in enumerate(shares))).alias("percentiles"))


def _between(i: int, share: float) -> Column:
    """The ``i``-th of shares whose lower and upper ranks ``at_ranks`` found as ``values``, interpolated."""
    low, high = F.col("values")[2 * i], F.col("values")[2 * i + 1]
    place = (F.col("n") - 1) * share
    return low + (high - low) * (place - F.floor(place))


def evaluation_summary(df: DataFrame, by: list[str], model: str = "model_prediction", base: str = "persistence_prediction", actual: str = "reference", least: int = 1) -> DataFrame:
    """AGG-18/19, CMP-14 by groups: metrics of model and baseline, improvements and status."""
    grouped = df.groupBy(*by).agg(F.struct(*sufficient(model, actual)).alias("m"), F.struct(*sufficient(base, actual)).alias("p"))
    m = grouped.select(*by, "m.*", "p").select(*by, F.col("n").alias("sample_count"), *(v.alias(k) for k, v in regression("model_").items()), "p")
    p = m.select(*(c for c in m.columns if c != "p"), "p.*").select(*(c for c in m.columns if c != "p"), *(v.alias(k) for k, v in regression("persistence_").items()))
    gains = skill(F.col("model_mae"), F.col("persistence_mae"))
    return p.select("*", gains["improvement"].alias("mae_improvement"), gains["improvement_pct"].alias("mae_improvement_pct"), gains["skill"].alias("mae_skill"), quality_status(F.col("model_mae"), F.col("persistence_mae"), F.col("sample_count"), least).alias("quality_status"))


def micro_macro(by_key: DataFrame) -> DataFrame:
    """AGG-20 of a summary by key (sample_count, model_mae, persistence_mae): one row."""
    beats = F.col("model_mae") < F.col("persistence_mae")
    return by_key.agg((F.sum(F.col("model_mae") * F.col("sample_count")) / F.sum("sample_count")).alias("micro_mae"), F.avg("model_mae").alias("macro_mae"), F.count("*").alias("keys"), F.count_if(beats).alias("keys_beating"), F.count_if(~beats).alias("keys_not_beating"))


def worst(by_key: DataFrame, key: str, n: int = 10, tolerance: float = 1e-12) -> DataFrame:
    """AGG-21, SRT-06: the ``n`` keys of largest model error, ties by key, with their verdict."""
    gap = F.col("persistence_mae") - F.col("model_mae")
    verdict = F.when(gap > tolerance, "improved").when(gap < -tolerance, "worse").otherwise("tied")
    return by_key.withColumn("verdict", verdict).orderBy(F.col("model_mae").desc(), key).limit(n)


def temporal(df: DataFrame, time: str, prediction: str = "model_prediction", actual: str = "reference") -> DataFrame:
    """AGG-22: metrics by hour, by month and by year in one pass over the data."""
    parts = df.withColumn("hour", F.hour(time)).withColumn("month", F.month(time)).withColumn("year", F.year(time))
    sets = parts.groupingSets([["hour"], ["month"], ["year"]], "hour", "month", "year").agg(F.grouping_id().alias("_set"), *sufficient(prediction, actual))
    kind = F.when(F.col("_set") == 3, "hour").when(F.col("_set") == 5, "month").otherwise("year")
    return sets.select(kind.alias("part"), F.coalesce("hour", "month", "year").alias("value"), "n", *(v.alias(k) for k, v in regression().items()))


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """AGG-23: counts of statuses and percentages, null on zero denominators."""
    status = F.col("status")
    counts = {"forecasts_total": F.count("*"), "forecasts_target_time_passed": F.count_if(F.col("target_time_passed")), "evaluated_count": F.count_if(status == "EVALUATED"), "pending_target_count": F.count_if(status == "PENDING_TARGET_TIME"), "pending_reference_count": F.count_if(status.isin("PENDING_REFERENCE", "PENDING_BASELINE")), "invalid_count": F.count_if(status == "INVALID_PROVENANCE"), "reference_conflict_count": F.count_if(status == "REFERENCE_CONFLICT"), "received_references": F.count_if(F.col("target_reference_received"))}
    out = df.groupBy(*by).agg(*(v.alias(k) for k, v in counts.items()))
    return out.select("*", F.greatest(F.lit(0), F.col("forecasts_total") - F.col("received_references")).alias("missing_references"), (ratio(F.col("received_references"), F.col("forecasts_total")) * 100).alias("reference_coverage_pct"), (ratio(F.col("evaluated_count"), F.col("forecasts_target_time_passed")) * 100).alias("evaluation_coverage_pct"))


def hourly_sums(df: DataFrame, by: list[str], time: str, prediction: str, actual: str) -> DataFrame:
    """AGG-24: sufficient statistics by group and hour."""
    return df.groupBy(*by, F.date_trunc("hour", time).alias("hour")).agg(*sufficient(prediction, actual))


def rolling(hourly: DataFrame, by: list[str], span_hours: int) -> DataFrame:
    """WIN-15: metrics of the ``span_hours`` ending at each observed hour, by time and not by rows."""
    w = Window.partitionBy(*by).orderBy(F.unix_seconds("hour")).rangeBetween(-(span_hours - 1) * 3600, 0)
    summed = hourly.select(*by, "hour", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in SUMS))
    return summed.select(*by, "hour", "n", *(v.alias(k) for k, v in regression().items()))


def rolling_by_key(hourly: DataFrame, keys: DataFrame, key: str, span_hours: int) -> DataFrame:
    """WIN-16: ``rolling`` for every known key at every observed hour, keys without rows included."""
    hours = hourly.select("hour").distinct()
    # each hour lists the known keys: hours times keys rows are what is asked for
    known = keys.select(key).distinct().agg(F.collect_list(key).alias("_keys"))
    every = hours.join(small(known)).select(F.explode("_keys").alias(key), "hour")
    return rolling(every.join(hourly, [key, "hour"], "left").fillna(0, list(SUMS)), [key], span_hours)


def slope(x: str, y: str) -> Column:
    """AGG-25: least squares, null for fewer than two points or constant x."""
    return F.when((F.count(F.when(F.col(x).isNotNull(), F.col(y))) >= 2) & (F.var_pop(x) > 0), F.regr_slope(y, x))
