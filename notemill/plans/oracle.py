"""SQL with the results of the catalogue's queries, for any engine that has the tables as views."""

from __future__ import annotations

from . import registry  # noqa: F401  the queries register their SQL
from .catalogue import ORACLES


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
