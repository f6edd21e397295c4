"""Imports every query module, so that the registry is complete."""

from hitledger.plans import client_queries, ingest_queries, live_queries, period_queries, report_queries, rollup_queries, stateful_queries  # noqa: F401
from hitledger.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
