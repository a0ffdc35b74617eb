"""What the registered queries share: the observation view of the test tables, in Spark and in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import six
from ..session import shared_folder, use_utc
from ..sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLE_SQL[key] = sql
        return function

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(use_utc(spark), sf_dir, name)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as observations: the event type is the location, value the temperature, props.k the other measures."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = load(spark, sf_dir, "events").withColumn("k", k)
    return e.select(
        "event_id", F.col("event_type").alias("location_id"), F.col("ts").alias("event_time"), "user_id", F.col("value").alias("temperature_c"), F.col("k").alias("humidity_pct"),
        ((F.col("k") % 4) * 0.25).alias("precipitation_mm"), (1000 + (F.col("k") % 40) * 0.5).alias("pressure_hpa"), (F.col("k") % 30).alias("wind_speed_kmh"), (F.col("k") % 30 + F.col("k") % 7).alias("wind_gust_kmh"),
        (10.0 + F.col("user_id") % 10).alias("latitude"), (105.0 + F.col("user_id") % 5).alias("longitude"),
    )


OBS = """obs AS (SELECT event_id, event_type AS location_id, ts AS event_time, user_id, value AS temperature_c, k AS humidity_pct, (k % 4) * 0.25 AS precipitation_mm,
  1000 + (k % 40) * 0.5 AS pressure_hpa, k % 30 AS wind_speed_kmh, k % 30 + k % 7 AS wind_gust_kmh, 10.0::DOUBLE + user_id % 10 AS latitude, 105.0::DOUBLE + user_id % 5 AS longitude
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""

MEASURES = ("temperature_c", "humidity_pct", "precipitation_mm", "pressure_hpa", "wind_speed_kmh", "wind_gust_kmh")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per location and observed hour: means of the measures, to six decimals."""
    hourly = observations(spark, sf_dir).groupBy("location_id", F.date_trunc("hour", "event_time").alias("event_time"))
    return hourly.agg(*(six(F.avg(m)).alias(m) for m in MEASURES))


def s6(expression: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.5001) / 1e6"


PANEL = OBS + ", panel AS (SELECT location_id, date_trunc('hour', event_time) AS event_time, " + ", ".join(f"{s6(f'avg({m})')} AS {m}" for m in MEASURES) + " FROM obs GROUP BY ALL)"


def seconds(time: str | Column) -> Column:
    return F.unix_seconds(time)


def sec(expression: str) -> str:
    return f"CAST(floor(epoch({expression})) AS BIGINT)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the next hour beside what came: the mean of this hour and the last, and this hour (persistence)."""
    from pyspark.sql import Window

    w = Window.partitionBy("location_id").orderBy("event_time")
    p = panel(spark, sf_dir)
    shaped = p.select("location_id", "event_time", F.lead("temperature_c").over(w).alias("reference"), ((F.col("temperature_c") + F.lag("temperature_c").over(w)) / 2).alias("model_prediction"), F.col("temperature_c").alias("persistence_prediction"))
    return shaped.filter("reference is not null and model_prediction is not null")


SCORED = PANEL + """, scored AS (SELECT * FROM (SELECT location_id, event_time, lead(temperature_c) OVER w AS reference, (temperature_c + lag(temperature_c) OVER w) / 2 AS model_prediction,
  temperature_c AS persistence_prediction FROM panel WINDOW w AS (PARTITION BY location_id ORDER BY event_time)) WHERE reference IS NOT NULL AND model_prediction IS NOT NULL)"""


def q(df: DataFrame, *exact: str, **rounded: str) -> DataFrame:
    """``exact`` columns as they are and ``rounded`` ones to six decimals."""
    return df.select(*exact, *(six(F.col(c)).alias(n) for n, c in rounded.items()))


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
