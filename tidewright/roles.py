"""Which columns of a frame play which part, so that operators are not tied to one domain."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    key: str = "location_id"
    time: str = "event_time"
    event_id: str = "event_id"
    ingested: str = "ingestion_time"
    source: str = "source"
    cadence_seconds: int = 3600


DEFAULT = Roles()
