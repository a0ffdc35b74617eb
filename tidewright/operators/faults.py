"""Deterministic replay with faults (STR-15): a columnar generator, no loop over rows.

Every row draws one number from its id and a seed; ranges of it make the row invalid, late, out of order or normal, in
that order of precedence; an independent draw re-emits it as a duplicate.  Late and out-of-order rows arrive so many
places later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shares:
    duplicate: float = 0.02
    invalid: float = 0.01
    late: float = 0.05
    out_of_order: float = 0.05
    late_places: int = 1000
    shuffle_places: int = 20


def draw(row_id: Column, seed: int, salt: str) -> Column:
    """In [0, 1), the same on every engine that has CRC-32."""
    return F.crc32(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), row_id.cast("string")).cast("binary")) / 4294967296.0


def replay(df: DataFrame, row_id: str, shares: Shares = Shares(), seed: int = 42) -> DataFrame:
    """Rows with fault, emission (0, or 1 of a duplicate) and arrival, the place by which to order them."""
    u, d = draw(F.col(row_id), seed, "fault"), draw(F.col(row_id), seed, "duplicate")
    a, b, c = shares.invalid, shares.invalid + shares.late, shares.invalid + shares.late + shares.out_of_order
    fault = F.when(u < a, "INVALID").when(u < b, "LATE").when(u < c, "OUT_OF_ORDER").otherwise("NORMAL")
    delay = F.when(fault == "LATE", shares.late_places).when(fault == "OUT_OF_ORDER", 1 + F.floor(draw(F.col(row_id), seed, "place") * shares.shuffle_places)).otherwise(0)
    emissions = F.when(d < shares.duplicate, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = df.withColumn("fault", fault).withColumn("_delay", delay).withColumn("emission", F.explode(emissions))
    made = made.withColumn("arrival", F.col(row_id) + F.col("_delay") + F.col("emission") * 0.5)
    return made.withColumn("fault", F.when(F.col("emission") == 1, "DUPLICATE").otherwise(F.col("fault"))).drop("_delay")


def corrupt(df: DataFrame, row_id: str, temperature: str = "temperature_c", humidity: str = "humidity_pct", rain: str = "precipitation_mm", key: str = "location_id", seed: int = 42) -> DataFrame:
    """Invalid rows get one of four defects: temperature 999, humidity 999, rain -999 or no key."""
    kind = F.when(F.col("fault") == "INVALID", F.floor(draw(F.col(row_id), seed, "kind") * 4))
    changes = {temperature: F.when(kind == 0, 999.0), humidity: F.when(kind == 1, 999.0), rain: F.when(kind == 2, -999.0)}
    out = {c: F.coalesce(bad, F.col(c)) for c, bad in changes.items()}
    return df.withColumns(out | {key: F.when(F.coalesce(kind == 3, F.lit(False)), F.lit(None)).otherwise(F.col(key))})
