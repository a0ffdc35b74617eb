"""Conservation and dataset audits (CMP-04/15/16/17/25, WIN-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from .features import SPLITS, hours, label_faults, split_name


def report(df: DataFrame, assertions: dict[str, Column]) -> DataFrame:
    """CMP-15: a row for each named assertion over a one-row frame, with PASS or FAIL (null fails)."""
    cells = [F.struct(F.lit(name).alias("assertion"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("result")) for name, ok in assertions.items()]
    return df.select(F.inline(F.array(*cells)))


def conservation(bronze: DataFrame, silver: DataFrame, dead: DataFrame, event_id: str = "event_id") -> DataFrame:
    """One row: what went in, what came out valid, invalid and as duplicates; they add up in a sound run."""
    valid_in = bronze.agg(F.count("*").alias("bronze"))
    out = silver.agg(F.count("*").alias("silver"), F.countDistinct(event_id).alias("silver_distinct"))
    return valid_in.join(out).join(dead.agg(F.count("*").alias("dead"))).withColumn("removed", F.col("bronze") - F.col("silver") - F.col("dead"))  # one row each


def out_of_order(df: DataFrame, key: str, arrival: str, time: str) -> DataFrame:
    """WIN-18: per key, rows that are earlier than the row that arrived before them."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(arrival))
    return df.select(key, (F.col(time) < before).alias("_back")).groupBy(key).agg(F.count("*").alias("n"), F.count_if("_back").alias("out_of_order"))


def dataset(df: DataFrame, key: str, time: str, hours_expected: bool = True) -> DataFrame:
    """CMP-16/17: per key and year, rows, distinct hours, duplicates, hours off the grid and hours missing within its span."""
    second = F.unix_seconds(time)
    on_grid, hour = second % 3600 == 0, F.floor(second / 3600)
    grouped = df.groupBy(key, F.year(time).alias("year")).agg(
        F.count("*").alias("rows"), F.countDistinct(time).alias("hours"), F.count_if(~on_grid).alias("off_grid"),
        F.countDistinct(F.when(on_grid, hour)).alias("whole"), F.min(hour).alias("lo"), F.max(hour).alias("hi"),
    )
    missing = F.col("hi") - F.col("lo") + 1 - F.col("whole")
    return grouped.select(key, "year", "rows", "hours", (F.col("rows") - F.col("hours")).alias("duplicates"), "off_grid", (missing if hours_expected else F.lit(0)).cast("long").alias("missing_hours"))


def allocation(expected: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """CMP-25: expected against observed, with what is absent on either side."""
    a, b = expected.select(*keys, F.col(value).alias("expected")), observed.select(*keys, F.col(value).alias("observed"))
    verdict = F.when(F.col("observed").isNull(), "MISSING").when(F.col("expected").isNull(), "UNEXPECTED").when(F.col("expected") == F.col("observed"), "MATCH").otherwise("DIFFERENT")
    return a.join(b, keys, "full_outer").withColumn("verdict", verdict)


def read_back(written: DataFrame, source: DataFrame, key: str, time: str, label: str, value: str, features: list[str], horizon_hours: int = 1, splits=SPLITS) -> DataFrame:
    """CMP-04: assertions over a feature table as it was written, against the source it was made of.

    Columns as the contract has them; unique keys; labels, identities and splits there; every feature finite; targets at
    the horizon, with the source's value at that time; each split within its bounds.
    """
    expected = [key, time, "target_time", *features, label, "split"]
    if missing := [c for c in expected if c not in written.columns]:
        return report(written.sparkSession.range(1), {"columns_as_agreed": F.lit(False), **{f"has_{c}": F.lit(False) for c in missing}})
    once = written.groupBy(key, time).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    infinite = [F.count_if(~finite(F.col(c))).alias(f"_{i}") for i, c in enumerate(features)]
    bounds = ~F.coalesce(F.col("split") == split_name(F.col("target_time"), splits), F.lit(False))
    identity = F.col(key).isNull() | F.col(time).isNull() | F.col("target_time").isNull()
    one = written.agg(
        F.count("*").alias("rows"),
        F.count_if(~finite(F.col(label))).alias("unlabelled"),
        F.count_if(F.col("split").isNull()).alias("unsplit"),
        F.count_if(identity).alias("nameless"),
        F.count_if(F.col("target_time") != F.col(time) + hours(horizon_hours)).alias("misaligned"),
        F.count_if(bounds).alias("beyond"),
        *infinite,
    )
    truth = label_faults(written, source, key, time, "target_time", label, value)
    row = one.join(once).join(truth)  # one row each
    checks = {
        "has_rows": F.col("rows") > 0,
        "columns_as_agreed": F.lit(written.columns == expected),
        "keys_unique": F.col("repeated") == 0,
        "identities_present": F.col("nameless") == 0,
        "labels_present": F.col("unlabelled") == 0,
        "splits_present": F.col("unsplit") == 0,
        "splits_in_bounds": F.col("beyond") == 0,
        "targets_aligned": F.col("misaligned") == 0,
        "labels_true": (F.col("missing") == 0) & (F.col("different") == 0),
        "features_finite": sum((F.col(f"_{i}") for i in range(len(features))), F.lit(0)) == 0,
    }
    return report(row, checks)


def shift(train: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """CMP-29: distributions of training and live rows beside each other, with the shift of means in training deviations."""
    from .metrics import distributions

    a, b = (distributions(df, columns).select("column", *(F.col(c).alias(f"{side}_{c}") for c in ("count", "mean", "std", "p50"))) for side, df in (("train", train), ("live", live)))
    gap = (F.col("live_mean") - F.col("train_mean")) / F.nullif(F.col("train_std"), F.lit(0.0))
    return a.join(b, "column", "full_outer").withColumn("mean_shift", gap)


def late_conservation(sent: DataFrame, gold: DataFrame, fault: str, n: str, keys: list[str]) -> DataFrame:
    """STR-08: rows sent and counted in ``gold`` by NORMAL and LATE, in one row; a row without a fault is unexpected.

    ``conserved``: every normal row counts, late rows are there, none counts twice, drops add up and no other fault occurs.
    """
    kind = F.coalesce(F.col(fault), F.lit("NULL"))
    a = sent.agg(
        F.count("*").alias("_sent"), F.count_if(kind == "NORMAL").alias("normal_generated"), F.count_if(kind == "LATE").alias("late_generated"),
        F.count_if(~kind.isin("NORMAL", "LATE")).alias("unexpected"),
    )
    b = gold.agg(*(F.coalesce(F.sum(F.when(kind == k, F.col(n))), F.lit(0)).alias(c) for k, c in (("NORMAL", "normal_accepted"), ("LATE", "late_accepted"))), F.coalesce(F.sum(n), F.lit(0)).alias("_counted"))
    twice = gold.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_keys"))
    one = a.join(b).join(twice)  # single rows
    drops = {f"{k}_dropped": F.col(f"{k}_generated") - F.col(f"{k}_accepted") for k in ("normal", "late")}
    one = one.select("*", *(v.alias(k) for k, v in drops.items()), (F.col("_sent") - F.col("_counted")).alias("total_dropped"))
    sums = F.col("total_dropped") == F.col("normal_dropped") + F.col("late_dropped")
    sound = (F.col("normal_dropped") == 0) & (F.col("late_generated") > 0) & (F.col("late_dropped") >= 0) & sums & (F.col("unexpected") == 0) & (F.col("duplicate_keys") == 0)
    counts = [f"{k}_{c}" for k in ("normal", "late") for c in ("generated", "accepted", "dropped")]
    return one.select(*counts, "total_dropped", "unexpected", "duplicate_keys", sound.alias("conserved"))
