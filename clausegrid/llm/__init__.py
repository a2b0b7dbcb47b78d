"""Operators for training data; nothing else in the library imports this subpackage."""

from clausegrid.llm.queries import ORACLES, QUERIES
from clausegrid.operators import sieve

__all__ = ["ORACLES", "QUERIES", "sieve"]
