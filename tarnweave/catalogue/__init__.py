"""Registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from . import cleaning, groups, operations, records, relational, reports, streams, time

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (relational, records, cleaning, time, operations, streams, groups, reports):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
