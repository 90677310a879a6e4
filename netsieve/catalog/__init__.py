"""Runnable queries, each with the SQL that states its result."""

from netsieve.catalog import ingestion, integrity, metrics, shield, stores  # noqa: F401
from netsieve.catalog.base import ORACLES, RUNNERS

__all__ = ["ORACLES", "RUNNERS"]
