"""Calendar and clock expressions (local calendar, cyclic encodings, alignment, the forecast timing contract)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp patterns of the observation feed, tried in this order.
PATTERNS = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mmX")


def parse_instant(text: Column) -> Column:
    """A timestamp by the first pattern that fits, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in PATTERNS))


def aligned(time: Column, seconds: int = 3600) -> Column:
    """FLT-07: whether an instant lies on the cadence."""
    return F.unix_seconds(time) % seconds == 0


def local_calendar(time: Column, zone: str = "Asia/Ho_Chi_Minh") -> dict[str, Column]:
    """Hour, weekday (Monday 0), month, day of year in a zone, and the cyclic pairs of hour, weekday and day of year."""
    local = F.from_utc_timestamp(time, zone)
    hour, weekday, day = F.hour(local), (F.dayofweek(local) + 5) % 7, F.dayofyear(local)
    out = {"local_hour": hour, "local_day_of_week": weekday, "local_month": F.month(local), "local_day_of_year": day}
    for name, value, period in (("hour", hour, 24.0), ("day_of_week", weekday, 7.0), ("day_of_year", day - 1, 365.25)):
        angle = value.cast("double") * (2.0 * math.pi / period)
        out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    return out


def timing(now: Column, horizon_hours: int = 1) -> dict[str, Column]:
    """CMP-08: current hour, last completed hour, target, lead seconds and whether the forecast is still ahead."""
    current = F.date_trunc("hour", now)
    completed = current - F.expr("INTERVAL 1 HOUR")
    target = completed + F.make_dt_interval(F.lit(0), F.lit(horizon_hours))
    lead = F.unix_micros(target) / 1e6 - F.unix_micros(now) / 1e6
    return {"current_hour": current, "completed_hour": completed, "target_time": target, "lead_seconds": lead, "prospective": lead > 0}
