"""All queries of this package but those of the training-data operators."""

from __future__ import annotations

from cadastra.plans import areas, briefings, catalogue, files, history, lookups, records, texts

MODULES = (history, areas, records, texts, catalogue, briefings, lookups, files)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
