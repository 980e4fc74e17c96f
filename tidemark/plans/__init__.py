"""All queries by name, with their SQL."""

from . import payloads, queries, reports, searches, store, trends

__all__ = ["payloads", "queries", "reports", "searches", "store", "trends"]
