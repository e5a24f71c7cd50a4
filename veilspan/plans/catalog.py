"""All queries of the de-identification operators, with their DuckDB equivalents."""

from . import imports, registers, relations, scalars, scores, sessions, spans, streams, surfaces  # noqa: F401  registration
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
