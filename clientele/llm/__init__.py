"""Operators of a training-data pipeline over documents, and their queries."""

from .oracle import ORACLE
from .queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
