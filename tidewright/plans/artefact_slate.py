"""Queries: Parquet footers, change logs from a version on, verified artefacts and saved ensembles as relations (§2.1, 2.11, 2.12)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.numbers import six
from ..operators import artefact, features, model
from ..sources import readers
from ..sources.merge import write_changes
from ..streaming import medallion as runs
from .base import PANEL, load, panel, query, s6, scratch, sec, seconds
from .metrics_slate import CANDIDATES, NAMES, _labelled

_TYPES = {"event_id": True, "user_id": True, "value": True, "day": True, "props": False}


def _footer_sql(column: str, bounded: bool) -> str:
    ends = ("CAST(min({0}) AS VARCHAR)", "CAST(max({0}) AS VARCHAR)") if bounded else ("CAST(NULL AS VARCHAR)",) * 2
    if column == "value":  # doubles print in their own way in each engine
        ends = (s6("min({0})"), s6("max({0})"))
        ends = tuple(f"CAST(CAST(round({e} * 1000) AS BIGINT) AS VARCHAR)" for e in ends)
    return f"SELECT event_type, count(*) AS rows, '{column}' AS \"column\", count(*) - count({column}) AS nulls, {ends[0].format(column)} AS least, {ends[1].format(column)} AS most FROM e GROUP BY event_type"


@query("WITH e AS (SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN event_id END AS event_id, user_id, value, CAST(ts AS DATE) AS day, props FROM events) " + " UNION ALL ".join(_footer_sql(*x) for x in _TYPES.items()))
def footer_inventory(spark, d):
    """SRC-12: rows, nulls and ends of each partition's columns from footers."""
    folder = scratch(spark)
    e = load(spark, d, "events").select("event_type", F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("event_id"), "user_id", "value", F.to_date("ts").alias("day"), "props")
    e.write.partitionBy("event_type").parquet(f"{folder}/events")
    told = readers.inventory(spark, f"{folder}/events", ["event_type"])
    plain = lambda c: F.when(F.col("column") == "value", F.round(six(F.col(c).cast("double")) * 1000).cast("long").cast("string")).otherwise(F.col(c))
    return told.select("event_type", "rows", "column", "nulls", plain("least").alias("least"), plain("most").alias("most"))


@query("SELECT event_id, CAST(event_id % 12 AS BIGINT) AS batch FROM events WHERE event_id % 12 >= 9")
def stream_from_version(spark, d):
    """SRC-06: twelve versions of a change log, streamed from the ninth on; two versions come after a restart."""
    folder, e = scratch(spark), load(spark, d, "events").select("event_id")
    for version in range(12):
        if version == 10:
            source = readers.change_stream(spark, f"{folder}/log", "event_id long", start=9, files_per_trigger=2)
            runs.drain(runs.append(source, f"{folder}/seen", f"{folder}/state"))
        write_changes(e.filter(F.col("event_id") % 12 == version), f"{folder}/log", version)
    source = readers.change_stream(spark, f"{folder}/log", "event_id long", start=9, files_per_trigger=2)
    runs.drain(runs.append(source, f"{folder}/seen", f"{folder}/state"))
    return spark.read.schema("event_id long, batch long").parquet(f"{folder}/seen")


class Line:
    """A linear model as it is kept in a file."""

    def __init__(self, content: bytes):
        self.weights = json.loads(content)

    def predict(self, frame):
        return sum(w * frame[c] for c, w in self.weights.items())


@query(f"WITH {PANEL} SELECT location_id, {sec('event_time')} AS second, {s6('0.5 * temperature_c + 0.25 * before')} AS prediction FROM (SELECT *, lag(temperature_c) OVER (PARTITION BY location_id ORDER BY event_time) AS before FROM panel) WHERE before IS NOT NULL")
def verified_scoring(spark, d):
    """UDF-02: predictions of a model file that each worker proves before it loads it."""
    text = json.dumps({"temperature_c": 0.5, "temp_lag_1h": 0.25})
    folder = scratch(spark)
    name = f"model-{folder.rsplit('-', 1)[-1]}.json"
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(text.encode()))
    out.close()
    shipped = artefact.ship(spark, str(path), artefact.digest(text.encode()))
    lag = features.lagged(features.Panel())["temp_lag_1h"]
    ready = panel(spark, d).select("location_id", seconds("event_time").alias("second"), "temperature_c", lag.alias("temp_lag_1h")).filter("temp_lag_1h is not null")
    scored = artefact.score(ready, ["temperature_c", "temp_lag_1h"], shipped, Line, ["location_id", "second"])
    return scored.select("location_id", "second", six(F.col("prediction")).alias("prediction"))


@query()
def feature_importance(spark, d):
    """SRT-09: gain and weight of each feature, by the nodes of the saved ensemble."""
    train, valid, _ = _labelled(spark, d)
    folder = scratch(spark)
    model.fit_until(train, valid, NAMES, "reference", CANDIDATES[1]).write().save(f"{folder}/model")
    return model.importance(spark, f"{folder}/model", NAMES)
