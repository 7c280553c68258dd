"""Registered queries over the driver's tables and their SQL equivalents."""

from gridwarden.workload import q_columns, q_daily, q_events, q_grid, q_resolution, q_risk, q_sources, q_spatial, q_stencil, q_stream, q_time, q_training  # noqa: F401
from gridwarden.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
