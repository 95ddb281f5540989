"""The query catalogue: one entry per operator family."""

from __future__ import annotations

from . import document_queries, fact_queries, file_queries, judge_queries, reference_queries, text_queries  # noqa: F401  they register
from .catalogue import QUERIES


def queries() -> dict:
    return dict(QUERIES)
