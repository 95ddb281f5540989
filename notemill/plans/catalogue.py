"""Registration of queries: a function of (spark, sf_dir) and, where SQL can tell the result, DuckDB's SQL beside it.

In the SQL, @name stands for an adapter of plans.adapters as a subquery.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import VIEWS, sql_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = re.sub(r"@(\w+)", lambda m: f"({sql_of(m[1], duck=True)})" if m[1] in VIEWS else m[0], sql)
        return f

    return register
