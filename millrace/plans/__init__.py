"""The relational, window, function and streaming queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
