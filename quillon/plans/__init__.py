"""All registered queries."""

from quillon.plans import search, text  # noqa: F401
from quillon.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
