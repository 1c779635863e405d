"""A relational engine on Spark: a compact SQL dialect, DataFrame operators and versioned tables."""

from .session import Engine, Session

__all__ = ["Engine", "Session"]
