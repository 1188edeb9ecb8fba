"""All queries of the core and their SQL."""

from __future__ import annotations

from sableflow.plans import backtests, core_problems, evaluations, marts, signals, storage, streams, texts, warehouse

_MODULES = [core_problems, backtests, signals, warehouse, texts, streams, marts, storage, evaluations]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
