"""Numeric expressions: finiteness, comparison-safe rounding, skill, percentiles, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def finite(value: Column) -> Column:
    """FLT-04: not null, not NaN, not infinite; never null."""
    x = value.cast("double")
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def six(value: Column) -> Column:
    """Six decimals, with ties kept away from so that engines agree."""
    return F.floor(value * 1e6 + 0.5001) / 1e6


def ratio(a: Column, b: Column) -> Column:
    """a / b, null on a zero or null denominator."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def percentile_linear(value: Column, *shares: float) -> Column:
    """AGG-10: exact, interpolated between ranks."""
    return F.percentile(value, list(shares)) if len(shares) > 1 else F.percentile(value, shares[0])


def percentile_approx(value: Column, *shares: float, accuracy: int = 10_000) -> Column:
    """AGG-09: mergeable sketch."""
    return F.percentile_approx(value, list(shares) if len(shares) > 1 else shares[0], accuracy)
