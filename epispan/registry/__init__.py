"""Registered queries with the SQL that recomputes them."""

from epispan.registry.base import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
