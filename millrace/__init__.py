"""Millrace: a batch SQL warehouse layer on PySpark, with a PostgreSQL-like dialect and its functions."""

from .engine import Engine
from .session import session

__all__ = ["Engine", "session"]
