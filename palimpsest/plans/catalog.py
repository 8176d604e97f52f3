"""Registered queries of the library and their SQL."""

from __future__ import annotations

from palimpsest.plans import audits, contracts, graph, groups, joins, reports, text, windows
from palimpsest.plans.fixtures import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audits", "contracts", "graph", "groups", "joins", "reports", "text", "windows"]
