"""Registered queries: the library's operators over the given tables."""

from workload import documents, evidence, kinds, literals, records, search, tables, votes  # noqa: F401
from workload.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
