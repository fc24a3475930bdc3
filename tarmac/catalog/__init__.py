"""Registered queries over a data folder, and the SQL that checks them."""

from tarmac.catalog import aggregates, features, joins, models, rows, scalars, scans  # noqa: F401
from tarmac.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
