"""Registered queries: every operator bound to the shared tables, with an independent SQL oracle."""

from __future__ import annotations

from . import aggregates, evidence, joins, plans, predicates, selection, sources, streams, temporal, texts  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
