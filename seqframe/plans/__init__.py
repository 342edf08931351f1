"""Queries over the given tables, with their SQL."""

from . import mass_tree_queries, profile_queries, sequence_queries
from .tables import REGISTRY, Tables

__all__ = ["REGISTRY", "Tables", "mass_tree_queries", "profile_queries", "sequence_queries"]
