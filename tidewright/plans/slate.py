"""The registered queries of the reference's own operators and the SQL they are held against."""

from __future__ import annotations

from . import artefact_slate, contract_slate, exact_slate, joins_slate, medallion, metrics_slate, panel_slate, perf_slate, record_slate, sink_slate, source_slate, stream_slate  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
