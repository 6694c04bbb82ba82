"""Every registered query of the library, and its SQL."""

from __future__ import annotations

from . import corpus, generation, loading, records, relational, search, tools

QUERIES: dict = {}
SQL: dict = {}
for _module in (corpus, search, tools, relational, records, generation, loading):
    QUERIES |= _module.book.queries
    SQL |= _module.book.sql
