"""Analysis of streaming runs (AGG-25..29, WIN-19/20, CMP-18..26, SRT-07/08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .metrics import slope

CLASSES = ("FAILED", "SATURATED", "NEAR_CAPACITY", "UNDER_CAPACITY")


def nth_batch(progress: DataFrame, n: int) -> DataFrame:
    """WIN-20: per stage the time by which each of its queries has completed ``n`` batches.

    ``progress``: stage, query, batch_id, captured.  A stage with a query of fewer batches has no row.
    """
    once = progress.groupBy("stage", "query", "batch_id").agg(F.max("captured").alias("captured"))
    ranked = once.withColumn("i", F.row_number().over(Window.partitionBy("stage", "query").orderBy("batch_id")))
    per_query = ranked.groupBy("stage", "query").agg(F.max(F.when(F.col("i") == n, F.col("captured"))).alias("cutoff"))
    return per_query.groupBy("stage").agg(F.max("cutoff").alias("cutoff"), F.count_if(F.col("cutoff").isNull()).alias("short")).filter("short = 0").drop("short")


def steady_window(progress: DataFrame, started: Column, ended: Column, warmup_seconds: float = 10.0, batches: int = 3, stages: int = 2) -> DataFrame:
    """CMP-18: one row: when the steady state starts (null until every stage is ready) and ends, and its samples."""
    cut = nth_batch(progress, batches).agg(F.count("*").alias("ready"), F.max("cutoff").alias("cutoff"))
    start = F.when(F.col("ready") == stages, F.greatest(F.col("cutoff"), F.timestamp_micros((F.unix_micros(started) + int(warmup_seconds * 1e6)).cast("long"))))
    window = cut.select(start.alias("steady_start"), ended.alias("steady_end"))
    inside = progress.join(F.broadcast(window)).agg(F.count_if((F.col("captured") >= F.col("steady_start")) & (F.col("captured") <= F.col("steady_end"))).alias("samples"))
    return window.join(inside)  # one row each


def stage_summary(progress: DataFrame) -> DataFrame:
    """CMP-19: per stage, batches, rows and rates."""
    return progress.groupBy("stage").agg(F.countDistinct("query", "batch_id").alias("batches"), F.sum("rows").alias("rows"), F.avg("processed_rate").alias("avg_rate"), F.percentile("processed_rate", 0.5).alias("median_rate"), F.max("duration_ms").alias("longest_ms"))


def latest_by(df: DataFrame, by: list[str], value: str, *order: str) -> DataFrame:
    """AGG-28: the value of the latest row by ``order``."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def lag_summary(samples: DataFrame, start: Column, steady: Column, end: Column, time: str = "captured", lag: str = "lag") -> DataFrame:
    """CMP-20: one row: start-up and steady peaks, mean, p95, last, slope a second, and the final lag."""
    t, y = F.col(time), F.col(lag)
    inside = (t >= start) & (t <= end)
    calm = inside & (t >= steady)
    shaped = samples.filter(t.isNotNull() & y.isNotNull()).withColumn("_x", F.when(calm, F.unix_micros(t) / 1e6)).withColumn("_y", F.when(calm, y.cast("double")))
    return shaped.agg(
        F.max(F.when(inside & (t < steady), y)).alias("startup_peak"), F.max("_y").alias("steady_peak"), F.avg("_y").alias("steady_mean"), F.percentile("_y", 0.95).alias("steady_p95"),
        F.max_by(F.col("_y"), F.when(calm, t)).alias("steady_last"), slope("_x", "_y").alias("slope"), F.max_by(y, t).alias("final_lag"), F.count("*").alias("samples"),
    )


def completion(df: DataFrame, by: list[str], time: str, rows: str, target: Column) -> DataFrame:
    """WIN-19: when the rows of a group first add up to the target."""
    running = F.sum(rows).over(Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_sum", running).groupBy(*by).agg(F.min(F.when(F.col("_sum") >= target, F.col(time))).alias("completed"))


def capacity(failed: Column, completed: Column, final_lag: Column, offered: Column, sustained: Column, lag_slope: Column, drain: Column, duration: Column) -> Column:
    """CMP-21: the class of a run."""
    share = ratio(sustained, offered)
    unknown = ~F.coalesce(offered > 0, F.lit(False)) | ~F.coalesce(sustained > 0, F.lit(False)) | lag_slope.isNull()
    calm = (lag_slope <= F.greatest(F.lit(10.0), offered * 0.02)) & (share >= 0.95) & F.coalesce(drain <= F.greatest(F.lit(15.0), F.coalesce(duration, F.lit(0.0)) * 0.25), F.lit(False))
    return (
        F.when(failed | final_lag.isNull(), "FAILED")
        .when(~completed | (final_lag > 0), "SATURATED")
        .when(unknown, "FAILED")
        .when((lag_slope > F.greatest(F.lit(20.0), offered * 0.10)) & (share < 0.90), "SATURATED")
        .when(calm, "UNDER_CAPACITY")
        .otherwise("NEAR_CAPACITY")
    )


def repetitions(runs: DataFrame, by: list[str], rate: str, kind: str = "capacity") -> DataFrame:
    """CMP-22, AGG-26: mean, median and extremes of a rate over runs, and the worst class among them."""
    rank = F.array_position(F.array(*(F.lit(c) for c in CLASSES)), F.col(kind))
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.avg(rate).alias("mean"), F.percentile(rate, 0.5).alias("median"), F.min(rate).alias("least"), F.max(rate).alias("most"), F.min_by(F.col(kind), rank).alias("worst"))


def scaling(baseline_rate: Column, rate: Column, baseline_cores: Column, cores: Column) -> dict[str, Column]:
    """CMP-23: speed-up, gain, compute multiple, efficiency and rows a core; null where a denominator isn't positive."""
    over = lambda a, b: F.when(b > 0, a / b)
    speedup, multiple = over(rate, baseline_rate), over(cores.cast("double"), baseline_cores)
    return {"speedup": speedup, "gain_pct": (speedup - 1) * 100, "compute_multiple": multiple, "efficiency": over(speedup, multiple), "rows_per_core": over(rate, cores)}


def exclusion_reasons(checks: dict[str, Column]) -> Column:
    """CMP-24: why a run can't be compared, in the order given; an empty list if it can."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(passed, F.lit(False)), why) for why, passed in checks.items())))


def pipeline_rate(bronze: Column, silver: Column, reasons: Column) -> Column:
    """The slower stage's rate of a run that can be compared."""
    return F.when(F.size(reasons) == 0, F.least(bronze, silver))


def best_config(configs: DataFrame, rate: str, order: list[str], within: float = 0.02, kind: str = "capacity") -> DataFrame:
    """SRT-08: of the configurations within ``within`` of the best rate, the first by ``order`` (nulls last).

    Saturated configurations count only if there are no others.
    """
    calm = configs.filter(F.col(rate).isNotNull()).withColumn("_calm", F.col(kind) != "SATURATED")
    everywhere = Window.partitionBy()  # a row a configuration
    pool = calm.withColumn("_any", F.max("_calm").over(everywhere)).filter("_calm or not _any")
    near = pool.withColumn("_top", F.max(rate).over(everywhere)).filter((F.col("_top") <= 0) | ((F.col("_top") - F.col(rate)) / F.col("_top") <= within))
    return near.orderBy(*(F.col(c).asc_nulls_last() for c in order)).limit(1).drop("_calm", "_any", "_top")


def skew(df: DataFrame, partition: Column, partitions: int) -> DataFrame:
    """AGG-27: least, most, mean and imbalance of rows a partition, empty partitions included."""
    every = df.sparkSession.range(partitions).select(F.col("id").alias("p"))
    counted = every.join(df.groupBy(partition.cast("long").alias("p")).agg(F.count("*").alias("n")), "p", "left").fillna(0, ["n"])
    return counted.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean")).select("*", ratio(F.col("most"), F.col("mean")).alias("imbalance"))


def config_parts(config: Column) -> dict[str, Column]:
    """Partitions, cores of either stage and workers of an identifier like p3-b1-s2-w1."""
    return {name: F.regexp_extract(config, r"^p(\d+)-b(\d+)-s(\d+)-w(\d+)$", i + 1).cast("int") for i, name in enumerate(("partitions", "bronze_cores", "silver_cores", "workers"))}
