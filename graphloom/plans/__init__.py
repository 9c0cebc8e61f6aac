"""Registered queries: importing the package registers all of them."""

from . import capture, catalogue, details, findings, mixed, reports, snapshots, sweeps  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
