"""Names of this package's queries and their SQL, for the entry module."""

from .queries import QUERIES
from .sql import SQL

__all__ = ["QUERIES", "SQL"]
