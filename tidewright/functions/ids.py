"""Deterministic identifiers: SHA-256 over joined parts, null parts as empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def joined(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def stable_id(*parts: Column, separator: str = "\0") -> Column:
    return F.sha2(joined(separator, *parts), 256)


def event_id(key: Column, time_text: Column) -> Column:
    return F.concat_ws("_", key, time_text)


def sourced_event_id(source: Column, key: Column, time: Column) -> Column:
    return joined("|", source, key, utc_text(time))


def forecast_id(model: Column, key: Column, feature_time: Column, horizon: Column) -> Column:
    return stable_id(model, key, utc_text(feature_time), horizon, separator="|")


def payload_hash(*fields: str) -> Column:
    """Of the fields as JSON, in the order given."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def log_partition(key: Column, partitions: int) -> Column:
    """CRC-32 of the key, modulo the number of partitions."""
    return F.crc32(key.cast("binary")) % partitions
