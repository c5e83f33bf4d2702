"""Versioned-metadata analytics and training-data operators on Spark DataFrames."""

from .session import ship

__all__ = ["ship"]
