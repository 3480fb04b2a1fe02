"""Whole jobs built from the operators, and the registry of named queries."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "q_telemetry", "q_geo", "q_masks", "q_raster", "q_tracks", "q_anomaly", "q_alerts", "q_streaming",
    "q_monitoring",
)


def load_queries():
    """Import every query module and return (queries, oracle SQL)."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
