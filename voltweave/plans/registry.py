"""All queries by name, with their oracle SQL."""

from .oracle import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
