"""Gates of a raw observation set before it is loaded (CMP-17), and probes of what is about to be written (JON-18, FLT-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import event_id
from ..functions.times import aligned, parse_instant
from .joins import member_flag


def _judged(raw: DataFrame, known: DataFrame) -> DataFrame:
    parsed = raw.withColumn("_at", parse_instant(F.col("event_time")))
    named = F.col("location_id").isNotNull() & F.col("event_time").isNotNull()
    sound = F.coalesce(F.col("event_id") == F.when(named, event_id(F.col("location_id"), F.col("event_time"))), F.lit(False))
    flagged = member_flag(parsed, known.select("location_id"), ["location_id"], "_known").withColumn("_sound", sound)
    on_hour = F.col("_at").isNotNull() & aligned(F.col("_at"))
    return flagged.withColumn("_counts", F.col("_known") & F.coalesce(on_hour, F.lit(False)))


def _repeated(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("_more")).agg(F.coalesce(F.sum("_more"), F.lit(0)).alias(name))


def raw_gates(raw: DataFrame, known: DataFrame, usable: Column) -> DataFrame:
    """A row (gate, n, result) for each gate over text rows (event_id, location_id, event_time, measures); n counts faults.

    ``known`` lists the places and ``usable`` says whether a row's measures are in order (null: they are not).  Repeated
    identities are counted once each time they come again; observations repeat by place and hour.  Empty input passes.
    """
    rows = _judged(raw, known)
    counts = {
        "event_id_missing": F.col("event_id").isNull(),
        "location_id_missing": F.col("location_id").isNull(),
        "event_time_missing": F.col("event_time").isNull(),
        "event_id_differs": ~F.col("_sound"),
        "location_unknown": F.col("location_id").isNotNull() & ~F.col("_known"),
        "time_malformed": F.col("event_time").isNotNull() & F.col("_at").isNull(),
        "time_off_hour": F.col("_at").isNotNull() & ~aligned(F.col("_at")),
        "measures_invalid": ~F.coalesce(usable, F.lit(False)),
    }
    one = rows.agg(*(F.count_if(condition).alias(gate) for gate, condition in counts.items()))
    ids = _repeated(rows.filter("event_id is not null"), ["event_id"], "event_id_repeated")
    seen = _repeated(rows.filter("_counts"), ["location_id", "_at"], "observation_repeated")
    gates = [*counts, "event_id_repeated", "observation_repeated"]
    cells = [F.struct(F.lit(g).alias("gate"), F.col(g).alias("n"), F.when(F.col(g) == 0, "PASS").otherwise("FAIL").alias("result")) for g in gates]
    return one.join(ids).join(seen).select(F.inline(F.array(*cells)))  # one row each


def completeness(raw: DataFrame, known: DataFrame, years: list[int]) -> DataFrame:
    """CMP-17 by place and year: rows, distinct hours, hours of the whole year that are missing, and whether any is."""
    rows = _judged(raw, known).filter("_counts").groupBy("location_id", F.year("_at").alias("year"), "_at").agg(F.count("*").alias("_n"))
    found = rows.groupBy("location_id", "year").agg(F.sum("_n").alias("rows"), F.count("*").alias("hours"))
    every = known.select("location_id").distinct().select("location_id", F.explode(F.array(*(F.lit(y) for y in years))).alias("year"))
    start = lambda year: F.unix_seconds(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    expected = ((start(F.col("year") + 1) - start(F.col("year"))) / 3600).cast("long")
    out = every.join(found, ["location_id", "year"], "left").fillna(0, ["rows", "hours"])
    return out.withColumn("missing_hours", expected - F.col("hours")).withColumn("affected", F.col("missing_hours") > 0)


def already_written(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """JON-18: the ids about to be written that are there already, each once; null ids are never equal."""
    return new.select(key).distinct().join(existing.select(key), key, "left_semi")


def in_run(df: DataFrame, run: str, column: str = "simulation_run_id") -> DataFrame:
    """FLT-12: the rows of one run."""
    return df.filter(F.col(column) == run)
