"""Spark-native hazard analytics over long tables of gridded fields."""

from gridwarden.session import build_session, shared_dir, tune

__all__ = ["build_session", "shared_dir", "tune"]
