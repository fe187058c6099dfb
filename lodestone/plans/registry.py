"""All queries of the engine by name, and their DuckDB counterparts."""

from __future__ import annotations

from lodestone.plans import relational, reports, retrieval, statements, texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (retrieval, relational, texts, statements, reports):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
