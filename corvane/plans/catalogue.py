"""All queries of the engine by name, and their DuckDB texts."""

from __future__ import annotations

from corvane.plans import cohort, estimators, fits, further, models, network, reports, selections, spectral, sweeps

MODULES = [network, cohort, spectral, sweeps, reports, models, further, fits, estimators, selections]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
