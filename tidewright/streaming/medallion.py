"""Streaming runs (STR-*): raw log to silver and dead letters, silver to gold, with restart-safe sinks.

The transforms are those of ``operators``; here are only triggers, checkpoints and sinks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import parse_instant
from ..operators import dedupe, quality
from ..sources.merge import write_changes
from ..sources.readers import OBSERVATION


def parse(bronze: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON payload to typed columns beside the lineage; what doesn't parse has nulls and so ends with the dead letters."""
    lineage = [c for c in bronze.columns if c != payload]
    shaped = bronze.select(*lineage, F.from_json(payload, OBSERVATION).alias("data")).select(*lineage, "data.*")
    return shaped.withColumns({"event_time": parse_instant(F.col("event_time")), "ingestion_time": parse_instant(F.col("ingestion_time"))})


def trigger(writer, seconds: int | None):
    """STR-07: every so many seconds, or all that is there and then stop."""
    return writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)


def append(df: DataFrame, path: str, checkpoint: str, seconds: int | None = None, name: str | None = None) -> StreamingQuery:
    """SNK-01, STR-06: append-only Parquet with a checkpoint."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return trigger(writer.queryName(name) if name else writer, seconds).start()


def silver(observed: DataFrame, valid: Column, path: str, checkpoint: str, watermark: str = "10 minutes", seconds: int | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """STR-01/02/12: deduplicated valid rows and dead letters of one source, as two queries with their own checkpoints."""
    good, bad = quality.split_valid(observed, valid)
    unique = dedupe.within_watermark(good, "event_id", "event_time", watermark)
    return append(unique, f"{path}/silver", f"{checkpoint}/silver", seconds, None), append(bad, f"{path}/dead", f"{checkpoint}/dead", seconds, None)


def upsert(df: DataFrame, path: str, checkpoint: str, seconds: int | None = None, shape: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """SNK-02, STR-05: updated rows of an aggregate as changes below ``path``, once each however often a batch is replayed."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_changes(shape(batch) if shape else batch, path, batch_id)

    return trigger(df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink), seconds).start()


def drain(*queries: StreamingQuery) -> None:
    """Wait for queries that stop by themselves; raises what ended one."""
    for q in queries:
        q.awaitTermination()


def stop_when(queries: list[StreamingQuery], asked: Callable[[], bool], poll_seconds: float = 1.0) -> None:
    """STR-14: stop all once ``asked``, after what is in flight; all stop when one ends."""
    while all(q.isActive for q in queries):
        if asked():
            for q in queries:
                q.processAllAvailable()
            break
        queries[0].awaitTermination(poll_seconds)
    for q in queries:
        q.stop()
