"""Queries over the driver tables, each with the SQL that must give the same rows."""

from labelflow.catalog import (  # noqa: F401
    balancing,
    chatting,
    dataset,
    evaluation,
    expressions,
    monitor,
    quality_checks,
    sampling_draws,
    scans,
    scored,
    streams,
)
from labelflow.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
