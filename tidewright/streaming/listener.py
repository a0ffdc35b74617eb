"""SNK-14, STR-14: progress of streaming queries as JSON lines."""

from __future__ import annotations

import json
import threading
from datetime import UTC, datetime

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Lifecycle events and progress, one JSON object a line, in a file of the driver."""

    def __init__(self, path: str, stage: str):
        self.path, self.stage, self._lock = path, stage, threading.Lock()

    def _add(self, kind: str, **more) -> None:
        line = json.dumps({"stage": self.stage, "event_type": kind, "captured_at_utc": datetime.now(UTC).isoformat(), **more})
        with self._lock, open(self.path, "a") as out:
            out.write(line + "\n")

    def onQueryStarted(self, event) -> None:
        self._add("query_started", query_id=str(event.id), name=event.name)

    def onQueryProgress(self, event) -> None:
        self._add("query_progress", query_id=str(event.progress.id), progress=json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:
        self._add("query_idle", query_id=str(event.id))

    def onQueryTerminated(self, event) -> None:
        self._add("query_terminated", query_id=str(event.id), exception=event.exception)


def progress_rows(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch, rows read) of a query's micro-batches once it has stopped by itself; Spark keeps the last hundred."""
    query.awaitTermination()
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]
