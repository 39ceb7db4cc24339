"""All queries of the bar engine, by name, and the SQL that states their results."""

from __future__ import annotations

from .functions import features, predicates
from .operators import audit, bars, controls, hypotheses, populations, portfolio, rules, states, stats, trades, venues, worlds
from .plans import search

MODULES = (bars, features, predicates, states, trades, stats, audit, portfolio, search, worlds, populations, rules, controls, venues, hypotheses)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
