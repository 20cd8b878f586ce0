"""Registered queries and their SQL."""

from . import control_queries, jobs_queries, ledger_queries, metric_queries, ordered_queries, stream_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
