"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from corpuslode.plans import chunk_queries, engine_queries, extraction_queries, hybrid_queries, judgement_queries, search_queries, signal_queries, text_queries  # noqa: F401  register their queries
from corpuslode.plans.registry import QUERIES, SQL

FLAGSHIP = "hyb1_hybrid_search"


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
