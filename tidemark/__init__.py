"""Versioned tables, file registration and reports on Spark."""

from .operators import MAIN, UnknownVersion, VersionedTable, days, months
from .session import get_session

__all__ = ["MAIN", "UnknownVersion", "VersionedTable", "days", "get_session", "months"]
