"""Registered queries and the SQL that checks them."""

from netloom.plans import communities, distances, graphs, tables  # noqa: F401
from netloom.plans.graphs import flagship
from netloom.plans.registry import ENTRIES

__all__ = ["ENTRIES", "flagship"]
