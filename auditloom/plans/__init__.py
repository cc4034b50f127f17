"""The engine's queries on the driver's tables, with the same in SQL."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
