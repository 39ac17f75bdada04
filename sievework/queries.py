"""All queries of the evidence library, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .plans import articles, carriers, evidence, feeds, governance, identity, ledger, lineage, markup, pipelines, press, published, rollups, signals, texts, validation

_PARTS = (evidence, texts, published, lineage, identity, feeds, articles, rollups, pipelines, governance, signals, markup, ledger, carriers, press, validation)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
