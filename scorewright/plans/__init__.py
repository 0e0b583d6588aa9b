"""Registered queries over the provided tables, with their SQL."""

from __future__ import annotations

from scorewright.plans import files, scores, space, streams, tables, text
from scorewright.plans.base import ORACLES, QUERIES

flagship = scores.flagship

__all__ = ["ORACLES", "QUERIES", "files", "flagship", "space", "streams", "tables", "text"]
