"""Registered queries over the sample tables, each with the SQL that gives the same answer."""

from semgraph.checks import attached, derived, graph, mapped, measured, profiled, quality, shaped  # noqa: F401
from semgraph.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
