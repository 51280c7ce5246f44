"""The queries of the library's operators."""

from tessera.plans import data, scores, stats  # noqa: F401
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
