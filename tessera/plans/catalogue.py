"""Imports every module that registers queries."""

from tessera.plans import adjudication, lifecycle, postings, relational, reports, scans, scoring, search, streaming, text
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "adjudication", "lifecycle", "postings", "relational", "reports", "scans", "scoring", "search", "streaming", "text"]
