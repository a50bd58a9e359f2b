"""The queries of the document-unit operators and their oracle SQL."""

from __future__ import annotations

from quire.plans import accounts, geometry, layouts, model, records, rules, state, units
from quire.streaming import jobs

FLAGSHIP = "batch_greedy_60_6000"
_CATALOGS = (units.catalog, rules.catalog, state.catalog, accounts.catalog, geometry.catalog, layouts.catalog, records.catalog, model.catalog, jobs.catalog)


def queries() -> dict:
    return {name: q for c in _CATALOGS for name, q in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for c in _CATALOGS for name, text in c.oracle.items()}
