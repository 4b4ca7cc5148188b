"""Registered queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from panelkit.registry import (
    backtests,
    comparisons,
    covariate_quality,
    decisions,
    features,
    ingest,
    joins,
    quality,
    reports,
    streams,
)

_MODULES = (
    ingest,
    quality,
    joins,
    features,
    backtests,
    comparisons,
    decisions,
    covariate_quality,
    reports,
    streams,
)


def all_queries() -> dict:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
