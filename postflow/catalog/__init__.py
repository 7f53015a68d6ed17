"""Registered queries: every operator over the shared tables, with its SQL counterpart."""

from . import (aggregates, composites, files, filters, joins, projections, scans, streams,  # noqa: F401
               windows)
from .base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
