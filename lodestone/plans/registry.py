"""All registered queries and their oracles; the modules of this package fill it."""

from __future__ import annotations

import importlib
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.entities import with_sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
MODULES = ("select", "joins", "aggregates", "ranking", "paging", "scalars", "retrieval", "state", "events", "refinement", "surfaces")


def query(entities: str = "", oracle: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name; ``oracle`` may use the named entities and all tables."""

    def register(f: Query) -> Query:
        assert f.__name__ not in _QUERIES, f.__name__
        _QUERIES[f.__name__] = f
        if oracle:
            body = textwrap.dedent(oracle).strip()
            _ORACLES[f.__name__] = with_sql(entities, body) if entities else body
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"lodestone.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
