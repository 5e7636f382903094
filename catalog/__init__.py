"""Registered queries: every operator over the given tables, each with its SQL twin where SQL can express it."""

from catalog.registry import ORACLES, QUERIES
from catalog import documents, ingest, requests, retrieval, streams  # noqa: F401  (registration)

__all__ = ["ORACLES", "QUERIES"]
