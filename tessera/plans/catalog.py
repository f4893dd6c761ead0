"""The registered queries: one entry for each operator, with its SQL twin where there is one."""

from __future__ import annotations

from tessera.operators import activation, coupling, factors, follow, labels, learn, profile, rules, search, series, signals, spectra
from tessera.plans import actions
from tessera.sources import artifacts
from tessera.streaming import telemetry

MODULES = (activation, labels, series, signals, coupling, profile, follow, rules, search, spectra, learn, factors, artifacts, telemetry, actions)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
