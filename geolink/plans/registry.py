"""Where queries register themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def rounded(name: str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)
