"""Every query of the analytics engine with the SQL that gives the same rows."""

from __future__ import annotations

from chatloom.plans import arrays, batches, categories, dedup, extensions, frames, layout, messages, ocr, recognition, settings, states, streams, text, times  # noqa: F401
from chatloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
